"""Comparing and reconciling result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_diff(left: DataFrame, right: DataFrame, keys, tolerance: float = 1e-12) -> DataFrame:
    """(keys, column, left, right): missing keys, unequal text, numbers apart by more than a relative and absolute tolerance."""
    keys = list(keys)
    cols = [c for c in left.columns if c not in keys]
    if set(cols) != {c for c in right.columns if c not in keys}:
        raise ValueError("the tables have different columns")
    types = dict(left.dtypes)
    a = left.select(*keys, *[F.col(c).alias(f"__a_{c}") for c in cols], F.lit(True).alias("__l"))
    b = right.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in cols], F.lit(True).alias("__r"))
    j = a.join(b, keys, "full")
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()

    def row(name, x, y):
        return F.struct(F.lit(name).alias("column"), x.cast("string").alias("left"), y.cast("string").alias("right"))

    checks = [F.when(F.col("__l").isNull(), row("(key)", F.lit("missing"), F.lit("present"))), F.when(F.col("__r").isNull(), row("(key)", F.lit("present"), F.lit("missing")))]
    for c in cols:
        x, y = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        if types[c] in ("double", "float"):
            gap = F.abs(x - y)
            same = x.eqNullSafe(y) | F.coalesce((gap <= tolerance) | (gap <= tolerance * F.greatest(F.abs(x), F.abs(y))), F.lit(False))
        else:
            same = x.eqNullSafe(y)
        checks.append(F.when(both & ~same, row(c, x, y)))
    return j.select(*keys, F.inline(F.array_compact(F.array(*checks))))


def panel_cells(summary: DataFrame, verdicts: DataFrame, versions) -> DataFrame:
    """(metric, comparison, cells by version as text, verdict): the rows of a report panel."""
    w = summary.groupBy("metric", "comparison").agg(*[F.max(F.when(F.col("version") == v, F.format_number("mean", 4))).alias(f"cell_{v}") for v in versions])
    return w.join(verdicts.select("metric", "comparison", "verdict", "words"), ["metric", "comparison"])


def verdict_tally(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("metric").agg(*[F.sum((F.col("verdict") == v).cast("bigint")).alias(n) for v, n in (
        ("better", "better"), ("not a clear difference", "not_clear"), ("no improvement", "no_improvement"))])
