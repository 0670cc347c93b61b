"""Exact global ranks, quantiles and prefix sums without moving all rows to one task.

A plain ``row_number() over (order by x)`` has one task sort the whole table. Here rows are first put into a few
hundred value buckets. Bucket sizes are a small aggregate whose running total gives each bucket's offset; rows are
then numbered inside their bucket only. Any bucket edges give the exact answer: edges only decide how even the work is.
A value that holds a large share of the rows is an edge itself, and its rows are spread again over the tie column, so
no bucket holds a hot value whole.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evenhand.session import materialise

#: Buckets at least and at most; between them one to every ROWS rows.
BUCKETS, MOST_BUCKETS, ROWS = 64, 10_000, 1_000_000


def _edges(df: DataFrame, col: str, buckets: int | None) -> list[float]:
    """Approximate quantiles of a column that cut it into ``buckets`` (by its number of rows if None), brought to the driver (a bounded list of numbers)."""
    buckets = buckets or min(MOST_BUCKETS, max(BUCKETS, df.count() // ROWS))
    probs = [i / buckets for i in range(1, buckets)]
    got = df.select(F.col(col).cast("double").alias(col)).approxQuantile(col, probs, 1.0 / (4 * buckets))
    return sorted({float(v) for v in got if v is not None and not math.isnan(v)})


def value_bucket(df: DataFrame, col: str, edges: list[float], out: str) -> DataFrame:
    """Bucket number by binary search over the edges (a JVM-side transformer)."""
    if not edges:
        return df.withColumn(out, F.lit(0))
    tmp = f"__{out}_v"
    splits = [float("-inf"), *edges, float("inf")]
    marked = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep").transform(
        df.withColumn(tmp, F.col(col).cast("double"))
    )
    return marked.withColumn(out, F.col(out).cast("int")).drop(tmp)


def _bucketed(df: DataFrame, col: str, tie: str, buckets: int | None, edges: list[float] | None = None, ties: list[float] | None = None) -> DataFrame:
    """Columns __b (value bucket) and __s (tie sub-bucket, only inside an edge value)."""
    edges = _edges(df, col, buckets) if edges is None else edges
    ties = (_edges(df, tie, buckets) if edges else []) if ties is None else ties
    out = value_bucket(df, col, edges, "__b")
    if not edges:
        return out.withColumn("__s", F.lit(0))
    out = value_bucket(out, tie, ties, "__s")
    lower = F.element_at(F.array(*[F.lit(e) for e in edges]), F.greatest(F.col("__b"), F.lit(1)))
    at_edge = (F.col("__b") >= 1) & (F.col(col).cast("double") == lower)
    return out.withColumn("__s", F.when(at_edge, F.col("__s")).otherwise(F.lit(2 * MOST_BUCKETS)))


def global_rank(df: DataFrame, col: str, tie: str, out: str = "rank", by: tuple[str, ...] = (),
                descending: bool = False, sum_cols: dict[str, str] | None = None, buckets: int | None = None,
                edges: list[float] | None = None, ties: list[float] | None = None) -> DataFrame:
    """Exact ``row_number`` over (by, col, tie), rows spread over many tasks; ties go to the smaller ``tie``.

    ``sum_cols`` maps a column to the name of its running total in rank order (inclusive). Bucket edges of the value (of its
    negative when descending) and of the tie column may be given; the input is read twice, so it is kept.
    """
    sign = -1 if descending else 1
    work = df.withColumn("__k", F.col(col).cast("double") * F.lit(float(sign))).persist()
    work = _bucketed(work, "__k", tie, buckets, edges, ties)
    sum_cols = sum_cols or {}
    sizes = work.groupBy(*by, "__b", "__s").agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__t_{o}") for c, o in sum_cols.items()]
    )
    before = W.partitionBy(*by).orderBy("__b", "__s").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, "__b", "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
        *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__o_{o}") for o in sum_cols.values()],
    )
    inside = W.partitionBy(*by, "__b", "__s").orderBy("__k", tie)
    ranked = work.withColumn("__r", F.row_number().over(inside))
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    for c, o in sum_cols.items():
        ranked = ranked.withColumn(f"__p_{o}", F.sum(c).over(running))
    joined = ranked.join(offsets, [*by, "__b", "__s"])
    joined = joined.withColumn(out, (F.col("__off") + F.col("__r")).cast("bigint"))
    for o in sum_cols.values():
        joined = joined.withColumn(o, F.col(f"__o_{o}") + F.col(f"__p_{o}"))
    drop = ["__k", "__b", "__s", "__off", "__r"]
    drop += [f"__o_{o}" for o in sum_cols.values()] + [f"__p_{o}" for o in sum_cols.values()]
    return joined.drop(*drop)


def positive_ranks(df: DataFrame, counted: DataFrame, col: str, tie: str, out: str, by: str, edges: list[float], ties: list[float], hint) -> DataFrame:
    """df with ``out`` of the rows whose ``col`` is positive replaced by their exact ``row_number`` over (by, col descending, tie); rows move once, nothing is kept.

    ``counted`` has the same rows and need not be df itself: bucket sizes are read from it. Edges are of the negative column
    and of the tie column. ``hint`` is put on the table of bucket offsets before it is joined.
    """
    def placed(d: DataFrame) -> DataFrame:
        d = _bucketed(value_bucket(d.withColumn("__k", -F.col(col)), tie, ties, "__t"), "__k", tie, None, edges, ties)
        ranked = F.col(col) > 0  # the others have their place already and are only spread
        return d.withColumn("__b", F.when(ranked, F.col("__b")).otherwise(-1)).withColumn("__s", F.when(ranked, F.col("__s")).otherwise(F.col("__t"))).drop("__t")

    sizes = placed(counted.where(F.col(col) > 0).select(by, col, tie)).groupBy(by, "__b", "__s").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(by).orderBy("__b", "__s").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(by, "__b", "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = W.partitionBy(by, "__b", "__s").orderBy("__k", tie)
    r = placed(df).withColumn("__r", F.row_number().over(inside)).join(hint(offsets), [by, "__b", "__s"], "left")
    return r.withColumn(out, F.when(F.col("__b") >= 0, (F.col("__off") + F.col("__r")).cast("bigint")).otherwise(F.col(out))).drop("__k", "__b", "__s", "__r", "__off")


def hash_rank(df: DataFrame, key: str, out: str, by: tuple[str, ...] = (), keep: bool = True) -> DataFrame:
    """Exact ``row_number`` over (by, key) for an md5 key: its first three digits are 4,096 even buckets. ``keep``: the key too.

    Rows move once and are kept with their place in the bucket, whose largest is the bucket's size; groups must be few."""
    work = df.withColumn("__b", F.substring(key, 1, 3)).repartition("__b")
    inside = W.partitionBy("__b", *by).orderBy(key)
    placed = work.withColumn("__r", F.row_number().over(inside))
    placed = (placed if keep else placed.drop(key)).persist()  # read twice
    sizes = placed.groupBy("__b", *by).agg(F.max("__r").alias("__n"))
    before = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = materialise(sizes.select("__b", *by, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")), "offsets")
    ranked = placed.join(F.broadcast(offsets), ["__b", *by])  # at most 4,096 rows a group, whatever the number of rows
    return ranked.withColumn(out, (F.col("__off") + F.col("__r")).cast("bigint")).drop("__b", "__off", "__r")


def hash_threshold(df: DataFrame, key: str, want: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``k``-th smallest md5 key per group, for every row (by, k) of the small table ``want``.

    Only the one bucket (of 4,096) that holds the wanted position is sorted; no other row is moved.
    """
    work = df.select(*by, F.col(key).alias("__key"), F.substring(key, 1, 3).alias("__b"))
    sizes = work.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = W.partitionBy(*by).orderBy("__b")
    spans = sizes.withColumn("__hi", F.sum("__n").over(upto)).withColumn("__lo", F.col("__hi") - F.col("__n"))
    cond = [(F.col("k") > F.col("__lo")) & (F.col("k") <= F.col("__hi"))]
    hit = spans.join(want, list(by)).where(cond[0]) if by else spans.join(F.broadcast(want), cond[0])
    small = work.join(F.broadcast(hit.select(*by, "__b", "__lo", "k")), [*by, "__b"])  # a row for each wanted one
    inside = W.partitionBy(*by, "__b", "k").orderBy("__key")
    return (
        small.withColumn("__r", F.row_number().over(inside) + F.col("__lo"))
        .where(F.col("__r") == F.col("k"))
        .select(*by, "k", F.col("__key").alias("threshold"))
    )


def exact_quantiles(df: DataFrame, col: str, probs: list[float], by: tuple[str, ...] = (),
                    buckets: int | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation) per group: rows (by…, p, value).

    Rows are first reduced to (group, value, count), which removes hot values; a group's buckets then need only
    running totals, and only the buckets that hold a wanted position are ordered.
    """
    by = tuple(by)
    vals = (
        df.where(F.col(col).isNotNull())
        .groupBy(*by, F.col(col).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    edges = _edges(df.where(F.col(col).isNotNull()), col, buckets)
    vals = value_bucket(vals, "__v", edges, "__b")
    sizes = vals.groupBy(*by, "__b").agg(F.sum("__c").alias("__n"))
    upto = W.partitionBy(*by).orderBy("__b")
    whole = W.partitionBy(*by)
    spans = (
        sizes.withColumn("__hi", F.sum("__n").over(upto))
        .withColumn("__lo", F.col("__hi") - F.col("__n"))
        .withColumn("__tot", F.sum("__n").over(whole))
    )
    want = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    pos = spans.withColumn("p", want).withColumn("__pos", F.col("p") * (F.col("__tot") - 1))
    pos = pos.withColumn("__k", F.explode(F.array(F.floor("__pos"), F.ceil("__pos"))))
    pos = pos.where((F.col("__k") >= F.col("__lo")) & (F.col("__k") < F.col("__hi"))).distinct()
    inside = W.partitionBy(*by, "__b").orderBy("__v")
    needed = pos.select(*by, "__b", "__lo").distinct()
    runs = (
        vals.join(needed, [*by, "__b"])
        .withColumn("__end", F.col("__lo") + F.sum("__c").over(inside))
        .withColumn("__start", F.col("__end") - F.col("__c"))
        .select(*by, "__b", "__v", "__start", "__end")
    )
    hit = pos.join(runs, [*by, "__b"]).where((F.col("__k") >= F.col("__start")) & (F.col("__k") < F.col("__end")))
    low = F.max(F.when(F.col("__k") == F.floor("__pos"), F.col("__v")))
    high = F.max(F.when(F.col("__k") == F.ceil("__pos"), F.col("__v")))
    frac = F.first("__pos") - F.floor(F.first("__pos"))
    return hit.groupBy(*by, "p").agg((low + (high - low) * frac).alias("value"))


def average_ranks(df: DataFrame, col: str, out: str, by: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """(by…, col, out): the mean rank of every distinct value, ties sharing one rank; work is on distinct values."""
    by = tuple(by)
    vals = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("__c"))
    vals = value_bucket(vals, col, _edges(df, col, buckets), "__b")
    sizes = vals.groupBy(*by, "__b").agg(F.sum("__c").alias("__n"))
    before = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = W.partitionBy(*by, "__b").orderBy(col)
    upto = F.sum("__c").over(inside)
    return (
        vals.withColumn("__u", upto).join(offsets, [*by, "__b"])
        .select(*by, col, (F.col("__off") + F.col("__u") - (F.col("__c") - 1) / 2.0).alias(out))
    )


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank correlation per group: pairs are counted first, so joins and sums see distinct pairs only."""
    by = tuple(by)
    pairs = df.groupBy(*by, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    named = df.select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    j = pairs.join(average_ranks(named, "__x", "rx", by), [*by, "__x"]).join(average_ranks(named, "__y", "ry", by), [*by, "__y"])
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    s = j.groupBy(*by).agg(
        F.sum(w).alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"), F.sum(w * rx * rx).alias("sxx"),
        F.sum(w * ry * ry).alias("syy"), F.sum(w * rx * ry).alias("sxy"))
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    return s.select(*by, F.when((vx > 0) & (vy > 0), (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy)).alias("spearman"))
