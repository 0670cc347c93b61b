"""Small column helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fsum(columns) -> Column:
    columns = list(columns)
    return reduce(lambda a, b: a + b, columns) if columns else F.lit(0.0)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rnd(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column: the query edge, where float order no longer matters."""
    cols = [F.round(F.col(f"`{n}`"), places).alias(n) if t in ("double", "float") else F.col(f"`{n}`")
            for n, t in df.dtypes]
    return df.select(*cols)


def interval(value: Column, se: Column, z: float):
    return (value - F.lit(z) * se).alias("ci_low"), (value + F.lit(z) * se).alias("ci_high")


def unpivot(df: DataFrame, keys, columns, name: str = "covariate", value: str = "value") -> DataFrame:
    """Long form of some columns; values become doubles."""
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(keys), list(columns), name, value)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df for a broadcast, its size checked as it runs: with more than ``most`` rows the query ends with an error and nothing is broadcast.

    The rows are counted by partial sums beside the table; the table itself is not moved for it."""
    n = df.agg(F.count(F.lit(1)).alias("__rows"))
    within = F.when(F.col("__rows") <= most, F.lit(True)).otherwise(F.raise_error(F.lit(f"more than {most} rows to broadcast")))
    return F.broadcast(df.crossJoin(F.broadcast(n)).where(within).drop("__rows"))
