"""13 Hard-negative mining with a residue-number-system matrix product.

Components are integers. Their residues modulo several primes below 1,024 are multiplied as float32 matrices in slices of ``SLICE`` components,
which single precision sums without error; the signed scores come back by Chinese remaindering. As many primes are used as
the largest possible score asks for.

Rows are packed into blocks where they lie, without a shuffle, so that no key can make a block large. Anchors form groups, blocks form runs; a task
holds one group and reads the blocks of one run one after another, keeping only the best rows found so far. The first pass finds
each anchor's positives, the second, with the windows that their scores open, its negatives.

Defined results: rows with a null vec_id, label or vector, or with any null or non-finite component, take no part; an anchor's own id is neither positive nor
negative of it; repeated rows are anchors, positives and negatives of their own; ties go to the smaller vec_id; an anchor without another row of its label
has no positives, a positive without a row in its window no negatives; an empty table has no results. Vectors shorter than the longest count as zero there, and an empty vector is zero everywhere. Scores
beyond a long are compared exactly and shown as the nearest long; vectors whose scores could have over 400 digits (none of floats has) are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import written

PRIMES = [1021, 1019, 1013, 1009, 997, 991, 983, 977, 971, 967, 953, 947, 941, 937, 929, 919]
SLICE = 64  # components whose products float32 sums exactly: SLICE * 510 * 510 < 2 ** 24
COMPLEMENT = str.maketrans("0123456789", "9876543210")
BLOCK = 4096  # rows of a block
RUN = 4  # blocks of a run at least
GROUP = 32768  # anchors of a group at most
CELLS = 1 << 17  # pairs of a group and a run at most, if there are no more groups: a task each
TOGETHER = 256  # anchors multiplied at once


def integers(vectors: DataFrame, scale: int, every: int, shift: int, labels: int) -> DataFrame:
    """id, label and v (floor(scale * x) as exact doubles) of the rows that take part; labels of ids divisible by ``shift`` are the next of ``labels``."""
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % shift == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label)
    rows = vectors.where(F.coalesce(good, F.lit(False)))
    # floor of a double is kept as a double: whole numbers beyond a long stay whole
    v = F.transform(x, lambda c: F.when(F.abs(c.cast("double") * scale) < 2.0**53, F.floor(c.cast("double") * scale).cast("double")).otherwise(c.cast("double") * scale))
    return rows.select(F.col("vec_id").cast("bigint").alias("id"), moved.alias("label"), v.alias("v"), (F.col("vec_id") % every == 0).alias("anchor"))


def matrix(lists: pa.ListArray) -> np.ndarray:
    """A list column as rows of doubles, the short ones filled up with zeros."""
    size = np.asarray(lists.value_lengths())
    v = np.zeros((len(size), int(size.max(initial=0))))
    v[np.arange(v.shape[1])[None, :] < size[:, None]] = np.asarray(lists.flatten())
    return v


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of at most ``BLOCK`` rows, cut from each task's own rows: part, nth, n, and the ids, labels, values and anchor flags as bytes; values take two bytes where they can."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, held, count = TaskContext.get().partitionId(), 0, [], 0

        def made() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            v = matrix(t.column("v").combine_chunks())
            small = np.abs(v).max(initial=0) < 1 << 15
            cells = [part, nth, t.num_rows, t.column("id").to_numpy().astype("<i8").tobytes(), t.column("label").to_numpy().astype("<i8").tobytes(), v.astype("<i2" if small else "<f8").tobytes(), bool(small),
                     t.column("anchor").to_numpy(zero_copy_only=False).astype(bool).tobytes(), v.shape[1], float(np.abs(v).max(initial=0))]
            return pa.RecordBatch.from_arrays([pa.array([c]) if not isinstance(c, int) or isinstance(c, bool) else pa.array([c], pa.int32()) for c in cells], names=["part", "nth", "n", "ids", "labels", "v", "small", "anchors", "width", "most"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, BLOCK - count)
                held.append(piece)
                count, at = count + piece.num_rows, at + piece.num_rows
                if count == BLOCK:
                    yield made()
                    nth, held, count = nth + 1, [], 0
        if count:
            yield made()

    return rows.mapInArrow(pack, "part int, nth int, n int, ids binary, labels binary, v binary, small boolean, anchors binary, width int, most double")


def unpacked(r: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and values of a block, values filled up to ``width``."""
    v = np.frombuffer(r["v"], "<i2" if r["small"] else "<f8").reshape(r["n"], r["width"]).astype(np.float64)
    return np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8"), np.pad(v, ((0, 0), (0, width - r["width"])))


class Residues:
    """Integer matrices as float32 residues modulo enough primes to tell all scores up to ``bound`` apart."""

    def __init__(self, bound: int):
        self.primes, self.product = [], 1
        for p in PRIMES if bound < math.prod(PRIMES) // 2 else further():
            if self.product > 2 * bound + 1:
                break
            self.primes.append(p)
            self.product *= p
        if self.product <= 2 * bound + 1:
            raise ValueError("scores of over 400 digits")
        self.weights = [self.product // p * pow(self.product // p, -1, p) for p in self.primes]
        # with few primes all sums of the reconstruction are exact doubles
        self.simple = len(self.primes) * 1024 * self.product < 1 << 53
        self.long = bound < 1 << 55  # a hundred times a score is a long too

    def of(self, v: np.ndarray) -> list[np.ndarray]:
        """The residues nearest to zero, one matrix a prime."""
        out = []
        for p in self.primes:
            r = np.fmod(v, p)  # exact for doubles of any size
            out.append((r - p * np.rint(r / p)).astype(np.float32))
        return out

    def scores(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """a @ b.T exactly: doubles where all scores are whole doubles, else longs, else Python integers."""
        parts = []
        for p, x, y in zip(self.primes, a, b, strict=True):
            total = np.zeros((len(x), len(y)), np.float32)
            for at in range(0, x.shape[1], SLICE):
                s = x[:, at : at + SLICE] @ y[:, at : at + SLICE].T + total
                total = s - np.float32(p) * np.rint(s * np.float32(1 / p))
            parts.append(total)
        if self.simple:
            whole = np.zeros(parts[0].shape)
            for w, r in zip(self.weights, parts, strict=True):
                whole += w * r.astype(np.float64)
            whole -= self.product * np.rint(whole / self.product)
            return whole
        digits: list[np.ndarray] = []  # mixed radix: x = d0 + p0 * (d1 + p1 * (d2 + …))
        for i, (p, r) in enumerate(zip(self.primes, parts, strict=True)):
            x = r.astype(np.int64)
            for q, d in zip(self.primes[:i], digits, strict=True):
                x = (x - d) * pow(q, -1, p) % p
            digits.append((x + p // 2) % p - p // 2)
        whole = digits[-1] if self.long else digits[-1].astype(object)
        for p, d in zip(self.primes[-2::-1], digits[-2::-1], strict=True):
            whole = whole * p + d
        return whole


def further() -> Iterator[int]:
    """All primes below 1,024 and above 100, from the largest: for scores beyond the product of ``PRIMES``."""
    return (p for p in range(1021, 100, -1) if all(p % q for q in range(2, 32)))


def ordered(x: int) -> str:
    """A whole number of up to 499 digits as text in the same order: sign and number of digits (500 and more; less for negative numbers), then the digits, of negative numbers their complements."""
    s = str(abs(x))
    return f"{500 + len(s):04d}{s}" if x >= 0 else f"{500 - len(s):04d}{s.translate(COMPLEMENT)}"


def whole(s: str) -> int:
    return int(s[4:]) if s >= "0500" else -int(s[4:].translate(COMPLEMENT))


def best(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each key, ties by the smaller id."""
    order = np.lexsort((ids, -score, key))
    first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.zeros(0, int)
    nth = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
    return order[nth < k]


class Found:
    """The best k (score, id) of each key so far."""

    def __init__(self, k: int):
        self.k, self.key, self.score, self.ids = k, np.zeros(0, np.int64), None, np.zeros(0, np.int64)

    def bars(self, keys: np.ndarray, kind: np.dtype) -> np.ndarray:
        """The score that a further row of each key must reach: the k-th so far, or none."""
        last = np.flatnonzero(np.r_[self.key[1:] != self.key[:-1], True][: len(self.key)])
        full = last[(last >= self.k - 1) & (self.key[np.maximum(last - self.k + 1, 0)] == self.key[last])]
        low = -math.inf if kind == object else np.finfo(kind).min if kind.kind == "f" else np.iinfo(kind).min
        out = np.full(len(keys), low, kind)
        if len(full):
            at = np.minimum(np.searchsorted(self.key[full], keys), len(full) - 1)
            held = self.key[full][at] == keys
            out[held] = self.score[full][at[held]]
        return out

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        score = score if self.score is None else np.concatenate([self.score, score])
        key, ids = np.concatenate([self.key, key]), np.concatenate([self.ids, ids])
        keep = best(key, score, ids, self.k)
        self.key, self.score, self.ids = key[keep], score[keep], ids[keep]


def positives(found: Found, m: Residues, anchors: dict, block: tuple, most: int) -> None:
    """Adds the block's rows of the anchors' own labels."""
    ids, labels, v = block
    for label in np.intersect1d(anchors["label"], labels):
        own, rows = np.flatnonzero(anchors["label"] == label), np.flatnonzero(labels == label)
        right = m.of(v[rows])
        for at in range(0, len(own), TOGETHER):
            a = own[at : at + TOGETHER]
            s = m.scores([x[a] for x in anchors["residues"]], right)
            other = anchors["id"][a][:, None] != ids[rows][None, :]
            i, j = np.nonzero(other & (s >= found.bars(a, s.dtype)[:, None]))
            found.add(a[i], s[i, j], ids[rows][j])


def negatives(found: Found, m: Residues, anchors: dict, block: tuple, most: int) -> None:
    """Adds the block's rows of other labels that lie in the windows; the key of a window is anchor * most + place of its positive."""
    ids, labels, v = block
    right = m.of(v)
    for at in range(0, len(anchors["id"]), TOGETHER):
        a = np.arange(at, min(at + TOGETHER, len(anchors["id"])))
        high, n = anchors["windows"][a], anchors["count"][a]  # (anchors, most) scores of positives, the highest first; how many there are
        s = m.scores([x[a] for x in anchors["residues"]], right)
        fits = (n > 0)[:, None] & (anchors["label"][a][:, None] != labels[None, :]) & (anchors["id"][a][:, None] != ids[None, :])
        fits &= (s <= high[:, :1]) & (100 * s >= 80 * high[np.arange(len(a)), np.maximum(n - 1, 0)][:, None])
        i, j = np.nonzero(fits)
        got, row = s[i, j], ids[j]
        order = np.lexsort((row, -got, i))
        i, got, row = i[order], got[order], row[order]
        for place in range(most):
            top = high[i, place]
            inside = (place < n[i]) & (got <= top) & (100 * got >= 80 * top)
            at_, sc, r = a[i[inside]], got[inside], row[inside]
            found.add(at_ * most + place, sc, r)


def mined(vectors: DataFrame, scale: int = 256, every: int = 100, most: int = 5, per_positive: int = 5, shift: int = 7, labels: int = 10, group: int = GROUP, run: int = RUN) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``, ``most`` positives are taken for each, and ``per_positive`` negatives within 80 to 100 per cent of a positive's score."""
    blocks = written(packed(integers(vectors, scale, every, shift, labels)), "negative_blocks")
    total = blocks.agg(F.count("*").alias("n"), F.max("width").alias("width"), F.max("most").alias("most")).first()
    spark, n = vectors.sparkSession, total["n"]
    width, bound = total["width"] or 0, (total["width"] or 0) * int(total["most"] or 0) ** 2

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(r["anchors"], bool))
                if len(at):
                    ids, lab, v = unpacked(r, width)
                    yield pa.RecordBatch.from_arrays([pa.array([(r["part"] << 32) + (r["nth"] << 12) + int(i) for i in at], pa.int64()), pa.array(ids[at]), pa.array(lab[at]), pa.array([x.tobytes() for x in v[at]], pa.binary())], names=["key", "id", "label", "v"])

    anchors = written(blocks.mapInArrow(anchor_rows, "key bigint, id bigint, label bigint, v binary"), "negative_anchors")
    m = anchors.count()
    groups = max(1, -(-m // group))
    runs = max(1, min(-(-n // run), CELLS // groups))
    deal = F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("g")
    beside = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("part", "nth"), F.lit(runs)).cast("int").alias("run"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("label"), "v", F.lit(None).cast("array<string>").alias("high"), "n", "ids", "labels", "small", "width")

    def through(asked: DataFrame, step, k: int, keyed: int) -> DataFrame:
        """step over every (group of anchors, run of blocks): key, nth (of ``keyed``), score and id of the best k. Anchors come first in each, then the blocks, one at a time."""
        sent = asked.select(deal, F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), F.lit(0).alias("kind"), "key", "id", "label", "v", "high", *[F.lit(None).cast(t).alias(c) for c, t in (("n", "int"), ("ids", "binary"), ("labels", "binary"), ("small", "boolean"), ("width", "int"))])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arithmetic, at, held, made, found = Residues(bound), None, [], None, None

            def flush() -> Iterator[pa.RecordBatch]:
                if found is not None and len(found.key):
                    for p in range(0, len(found.key), 65536):
                        key = found.key[p : p + 65536]
                        yield pa.RecordBatch.from_arrays([pa.array([made["key"][x] for x in key // keyed], pa.int64()), pa.array((key % keyed).astype(np.int32)), pa.array([ordered(int(x)) for x in found.score[p : p + 65536]], pa.string()), pa.array(found.ids[p : p + 65536])], names=["key", "place", "score", "other"])

            for batch in batches:
                for r in batch.to_pylist():
                    if (r["g"], r["run"]) != at:
                        yield from flush()
                        at, held, made, found = (r["g"], r["run"]), [], None, None
                    if r["kind"] == 0:
                        held.append((r["key"], r["id"], r["label"], np.frombuffer(r["v"], "<f8"), r["high"]))
                        continue
                    if made is None and held:
                        made, found = together(held, arithmetic), Found(k)
                        held = []
                    if made is not None:
                        step(found, arithmetic, made, unpacked(r, width), keyed)
            yield from flush()

        def together(rows: list[tuple], arithmetic: Residues) -> dict:
            kind = np.float64 if arithmetic.simple else np.int64 if arithmetic.long else object
            windows = np.zeros((len(rows), most), kind)
            for i, r in enumerate(rows):
                for j, s in enumerate(r[4] or []):
                    windows[i, j] = whole(s) if kind is object else kind(whole(s))
            return {"key": [r[0] for r in rows], "id": np.array([r[1] for r in rows]), "label": np.array([r[2] for r in rows]), "residues": arithmetic.of(np.array([r[3] for r in rows]).reshape(len(rows), width)),
                    "windows": windows, "count": np.array([len(r[4] or []) for r in rows])}

        both = sent.unionByName(beside).repartition(groups * runs, "g", "run").sortWithinPartitions("g", "run", "kind")
        found = both.mapInArrow(work, "key bigint, place int, score string, other bigint")
        nth = F.row_number().over(Window.partitionBy("key", "place").orderBy(F.desc("score"), "other"))
        return found.withColumn("nth", nth).where(F.col("nth") <= k)

    if not n or not m:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    pos = written(through(anchors.withColumn("high", F.lit(None).cast("array<string>")), positives, most, 1).select("key", (F.col("nth") - 1).alias("place"), F.col("score").alias("positive_score"), F.col("other").alias("positive_id")), "negative_positives")
    high = pos.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("high"))  # at most ``most``
    found = through(anchors.join(high, "key"), negatives, per_positive, most)
    ends = anchors.select("key", F.col("id").alias("anchor_id"))

    def as_long(c: str) -> Column:
        most = F.lit(ordered(2**63 - 1)), F.lit(ordered(-(2**63)))
        digits = F.substring(F.greatest(F.least(F.col(c), most[0]), most[1]), 5, 400)
        return F.when(F.col(c) >= ordered(0), digits).otherwise(F.concat(F.lit("-"), F.translate(digits, "0123456789", "9876543210"))).cast("bigint").alias(c)

    out = found.select("key", "place", F.col("nth").alias("rank"), F.col("score").alias("negative_score"), F.col("other").alias("negative_id")).join(pos, ["key", "place"]).join(ends, "key")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", as_long("positive_score"), as_long("negative_score"))


#: Every score in SQL, for small tables.
SQL = """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] v from embeddings
   where embedding is not null and vec_id is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id anchor_id, a.label anchor_label, e.vec_id, e.label, cast(list_sum([a.v[i] * e.v[i] for i in range(1, len(a.v) + 1)]) as bigint) score from e a join e on a.vec_id % 100 = 0 and e.vec_id <> a.vec_id),
 p as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) nth from s where label = anchor_label),
 n as (select p.anchor_id, p.vec_id positive_id, s.vec_id negative_id, p.score positive_score, s.score negative_score, row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) rank
   from p join s on s.anchor_id = p.anchor_id and s.label <> s.anchor_label and 80 * p.score <= 100 * s.score and s.score <= p.score where p.nth <= 5)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 5"""
