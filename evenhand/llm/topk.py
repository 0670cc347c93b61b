"""4 Exact top-k search: aggregation without random access over sorted lists, one list per component.

A block of vectors holds, for each component, its vectors in order of that component. A query reads the list of component d from
its high end where the query's d-th value is positive, from its low end where it is negative, a step at a time, and never
looks a vector up elsewhere. After each step a vector has a lower and an upper bound of its score: what was read of it, and
for unread lists the list's last value or the value read last. Reading stops as soon as no outsider, seen or
unseen, has an upper bound that reaches the k-th lower bound; then the scores of those left are resolved. Queries run in
groups, so that bounds of all are matrix products. Queries and vectors meet block by block; each pair of blocks gives k
rows a query, which are merged by query.

Defined results: vectors that are null or hold a null or a non-finite component take no part, nor do rows without a
vec_id; a query is never its own result; repeated vec_ids are separate candidates but no candidates of a query with their id; ties go to the smaller vec_id; an
empty table has no results; fewer candidates than k are all returned; components are quantised to longs, scores beyond a long are compared exactly and shown as the nearest long. Vectors shorter than the longest count as zero there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import written


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) of every component, of the vectors that take part."""
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(good & F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint")).alias("v"))


def exact_kind(d: int, most: int) -> tuple[type, float]:
    """The fastest type in which scores of d components of up to ``most`` are exact, and a value below all of them."""
    if d * most * most < 1 << 23:
        return np.float32, -np.inf
    if d * most * most < 1 << 52:
        return np.float64, -np.inf
    return (np.int64, np.iinfo(np.int64).min) if d * most * most < 1 << 61 else (object, -np.inf)


class SortedLists:
    """A block of vectors as one sorted list per component. Sums are exact: floats only where all scores fit into them, Python integers where longs don't hold them."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, most: int = 1 << 30, steps: int = 8):
        order = np.argsort(ids, kind="stable")
        n, d = v.shape
        self.kind, self.lowest = exact_kind(d, most)
        self.ids, self.v = ids[order], v[order].astype(self.kind)
        rank = np.empty((n, d), np.int32)
        by = np.argsort(self.v, axis=0, kind="stable")
        np.put_along_axis(rank, by, np.arange(n, dtype=np.int32)[:, None], axis=0)
        self.rank, self.sorted = rank, np.take_along_axis(self.v, by, axis=0)
        # lists are read to the middle first: before that, unread parts outweigh what is known
        self.depths = np.unique(np.ceil(np.linspace(n / 2, n, steps // 2 + 1)).astype(int))

    def search(self, qid: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, vec_id, score) of the best k of this block for each query."""
        n, q = len(self.ids), q.astype(self.kind)
        rows, out_ids, out_scores = [], [], []
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        live = np.arange(len(q))
        low = np.zeros((len(q), n), self.kind)
        seen_from = 0
        for depth in self.depths:
            if not len(live):
                break
            # what this step reads, from either end
            high = (self.rank >= n - depth) & (self.rank < n - seen_from)
            deep = (self.rank < depth) & (self.rank >= seen_from)
            low += up[live] @ np.where(high, self.v, 0).T
            low += down[live] @ np.where(deep, self.v, 0).T
            seen_from = depth
            unread_high, unread_low = (self.rank < n - depth).astype(self.kind).T, (self.rank >= depth).astype(self.kind).T
            last_high, last_low = self.sorted[max(0, n - depth)], self.sorted[min(n - 1, depth - 1)]
            best = low + (up[live] * last_high) @ unread_high + (down[live] * last_low) @ unread_low
            worst = low + (up[live] * self.sorted[0]) @ unread_high + (down[live] * self.sorted[-1]) @ unread_low if depth < n else best.copy()
            own = self.ids[None, :] == qid[live][:, None]
            best[own] = worst[own] = self.lowest
            kth = np.partition(worst, n - k, axis=1)[:, n - k] if n >= k else np.full(len(live), self.lowest)
            left = (best >= kth[:, None]) & ~own
            few = left.sum(axis=1) <= max(4 * k, n // 16)
            for i in np.flatnonzero(few | (depth == n)):
                at = np.flatnonzero(left[i])
                wide = np.float64 if self.kind is np.float32 else self.kind
                score = self.v[at].astype(wide) @ q[live[i]].astype(wide)  # resolved
                top = np.lexsort((self.ids[at], -score))[:k] if len(at) <= 4 * k else self.first(score, at, k)
                rows.append(np.full(len(top), live[i]))
                out_ids.append(self.ids[at[top]])
                out_scores.append(score[top])
            go_on = ~(few | (depth == n))
            live, low = live[go_on], low[go_on]
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(out_ids), np.concatenate(out_scores)

    @staticmethod
    def first(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """The k highest scores; places are in order of vec_id, so the earlier place wins a tie."""
        bar = np.partition(score, len(score) - k)[len(score) - k]
        over, same = np.flatnonzero(score > bar), np.flatnonzero(score == bar)
        top = np.concatenate([over, same[: k - len(over)]])
        return top[np.lexsort((at[top], -score[top]))]


def halves(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """high and low: a score is high * 2 ** 62 + low, in the same order."""
    scores = scores if scores.dtype == object else scores.astype(np.int64)
    return (scores >> 62).astype(np.int64), (scores & ((1 << 62) - 1)).astype(np.int64)


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """The rows in ``blocks`` blocks by hash: block, ids and values as arrays, one row a block."""
    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        lists = table.column("v").combine_chunks()
        size = np.array(lists.value_lengths())
        v = np.zeros((len(ids), int(size.max(initial=0))), np.int64)
        v[np.arange(v.shape[1])[None, :] < size[:, None]] = np.asarray(lists.flatten())
        v = v.astype(np.int32) if np.abs(v).max(initial=0) < 1 << 31 else v
        return pa.table([pa.array([table.column("block")[0].as_py()], pa.int32()), pa.array([ids.astype(np.int64).tobytes()]), pa.array([v.tobytes()]), pa.array([v.shape[1]], pa.int32())], names=["block", "ids", "v", "width"])

    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(pack, "block int, ids binary, v binary, width int")


def unpack(ids: bytes, v: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(v, np.int32 if len(v) == 4 * len(i) * width else np.int64).reshape(len(i), width).astype(np.int64) if width else np.zeros((len(i), 0), np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block: int = 4096, together: int = 512, tasks: int = 1 << 16) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors of each query row. ``is_query`` selects the query rows.

    Every pair of a query block and a vector block is one row of two packed blocks; no rows are paired. A group of pairs
    shares its vector block's lists; there are at most ``tasks`` groups, which read their pairs one after another."""
    rows = written(quantised(vectors, scale), "vectors")
    n, m = rows.count(), rows.where(is_query).count()
    if not n or not m:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("bigint").alias("score")).limit(0)
    vb, qb = -(-n // block), -(-m // together)
    lists = written(packed(rows, vb), "vector_blocks")
    asked = packed(rows.where(is_query), qb).select(F.col("block").alias("query_block"), F.col("ids").alias("qids"), F.col("v").alias("qv"), F.col("width").alias("qwidth"))
    pairs = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(vb - 1)))).repartition(min(vb * qb, tasks), "block", "query_block").join(lists, "block")

    def run(batches):
        made: tuple[tuple, SortedLists] | None = None
        for batch in batches:
            for r in batch.to_pylist():
                ids, v = unpack(r["ids"], r["v"], r["width"])
                qids, q = unpack(r["qids"], r["qv"], r["qwidth"])
                d = max(v.shape[1], q.shape[1])
                v, q = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (v, q))
                most = int(max(np.abs(v).max(initial=0), np.abs(q).max(initial=0)))
                if made is None or made[0] != (r["block"], d, most):
                    made = ((r["block"], d, most), SortedLists(ids, v, most))
                for at in range(0, len(qids), 256):
                    part = qids[at : at + 256]
                    row, vec, score = made[1].search(part, q[at : at + 256], k)
                    high, low = halves(score)
                    yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(vec), pa.array(high), pa.array(low)], names=["query_id", "vec_id", "high", "low"])

    found = pairs.select("block", "ids", "v", "width", "qids", "qv", "qwidth").mapInArrow(run, "query_id bigint, vec_id bigint, high bigint, low bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id"))
    score = F.when(F.col("high") > 1, F.lit(2**63 - 1)).when(F.col("high") < -2, F.lit(-(2**63))).otherwise(F.shiftleft("high", 62) + F.col("low"))
    return found.withColumn("rank", rank).withColumn("score", score).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Every score in SQL, for small tables.
SQL = """with e as (select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] v from embeddings
   where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select q.vec_id query_id, e.vec_id, cast(list_sum([q.v[i] * e.v[i] for i in range(1, len(q.v) + 1)]) as bigint) score from e q join e on q.vec_id % 20 = 0 and e.vec_id <> q.vec_id),
 r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 20"""
