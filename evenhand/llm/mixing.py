"""8 Mixing sources to target weights: exact block quotas per source, split among output shards by a multivariate-hypergeometric tree.

Each document of a source has a seeded place between 0 and 1; equal ranges of it are the source's blocks, so blocks are a
random permutation of its documents. A source with target t and size s gives each block floor(t / s) times whole, and once more
the first blocks up to what is left; of the block in which that ends (and its neighbours, if it has few documents), documents
as long as they fit, the largest first. The blocks due from
all sources are then split among the shards: a node of the tree halves its shards and draws how many blocks of each source
go left, without replacement, and so on down; shard by shard, each source's next blocks in a random order are handed out, so draws
are disjoint. Within a shard rows are ordered by another seeded hash.

The driver holds a number per source and block (at most ``max_cells``) and per source and shard, whatever the size of the data.

Defined results: null text and text without a word has size 0 and is never taken; a source without words has target 0; a null
source is a source of its own, ranked last; repeated rows are separate documents at the same place; an empty table gives
an empty mix. Reruns with one seed agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import quoted, without, written

TAIL = 64  # documents at least among which the last words of a source are found
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], most: float = 3.0) -> list[float]:
    """What each source is to give: shares of the whole by weight; what is above ``most`` times a source's size is shared again."""
    out, open_ = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s}
    left = float(sum(sizes))
    while open_:
        per = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if per * weights[i] > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = per * weights[i]
            return out
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def split_quotas(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(sources, shards): the quotas split among the shards, which get equal numbers of blocks, by halves."""
    if shards == 1:
        return quota[:, None]
    left = shards // 2
    draw = int(quota.sum() * left // shards)
    part = rng.multivariate_hypergeometric(quota, draw, method="marginals") if quota.sum() else quota
    return np.concatenate([split_quotas(part, left, rng), split_quotas(quota - part, shards - left, rng)], axis=1)


@dataclass
class Mix:
    """Per source: rank, size, target, whole copies, the block in which the rest ends, the block after its tail, and the words due from that tail."""

    table: list[tuple]
    blocks: int
    quotas: np.ndarray


def place(seed: int) -> Column:
    """A number from 0 to below 2^62, uniform by document."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text"))), 2)


def sized(docs: DataFrame, seed: int, *more: str) -> DataFrame:
    return docs.select("doc_id", "source", *more, F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size"), place(seed).alias("place"))


def plan(rows: DataFrame, weights: tuple[int, ...], most: float, seed: int, shards: int | None, shard_words: int, max_sources: int, max_cells: int) -> Mix:
    """The quotas of all sources, from the sizes of their blocks; more than ``max_sources`` sources are an error."""
    totals = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).limit(max_sources + 1).collect()}
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    sizes = [totals[s] for s in names]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], most)
    blocks = 1 << max(4, min(12, int(np.log2(max_cells / max(1, len(names))))))
    by_block = rows.groupBy("source", (F.col("place") / (1 << 62) * blocks).cast("int").alias("block")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    words, docs = {(r["source"], r["block"]): r["size"] for r in by_block}, {(r["source"], r["block"]): r["n"] for r in by_block}
    table, quota = [], []
    for s, size, t in zip(names, sizes, want, strict=True):
        rate = t / size if size else 0.0
        whole = int(rate + 1e-9)
        rest, at = max(0.0, t - whole * size), 0
        while at < blocks and words.get((s, at), 0) <= rest:
            rest -= words.get((s, at), 0)
            at += 1
        tail, n = at, 0
        while at > 0 and n < TAIL // 2:
            at -= 1
            n += docs.get((s, at), 0)
            rest += words.get((s, at), 0)
        n = 0
        while tail < blocks and n < TAIL:
            n += docs.get((s, tail), 0)
            tail += 1
        table.append((s, size, t, whole, at, tail, rest))
        quota.append(whole * blocks + tail)
    rng = np.random.Generator(np.random.PCG64(seed))
    shards = shards or min(65_536, 8 * max_cells // max(1, len(names)), sum(sizes) // shard_words + 1)
    return Mix(table, blocks, split_quotas(np.array(quota, np.int64), shards, rng) if quota else np.zeros((0, shards), np.int64))


def first_fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a source's tail, the largest first: each document that still fits is taken."""
    rows = rows.sort_values(["size", "place"], ascending=[False, True])
    due, take = float(rows["due"].iloc[0]) + 0.5 if len(rows) else 0.0, []
    for size in rows["size"]:
        take.append(size <= due)
        due -= size if take[-1] else 0
    return pd.DataFrame({"tail_src": rows["src"], "tail_place": rows["place"], "fits": take})


def copies(rows: DataFrame, small: DataFrame, mix: Mix) -> DataFrame:
    """rows (doc_id, source, size, place, …) with source_size, target, block and copies; ``small`` has the same rows without texts.

    Only the tails of the sources (a block each, or a few documents) are shuffled."""
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame(mix.table, "src string, source_size bigint, target double, whole int, ends int, tail int, due double"))  # a row per source

    def near(x: DataFrame) -> DataFrame:
        return x.join(table, F.col("source").cast("string").eqNullSafe(F.col("src"))).withColumn("block", (F.col("place") / (1 << 62) * mix.blocks).cast("int"))

    in_tail = (F.col("block") >= F.col("ends")) & (F.col("block") < F.col("tail"))
    tails = near(small).where(in_tail).groupBy("src", "place").agg(F.sum("size").alias("size"), F.first("due").alias("due"))
    fits = written(tails.groupBy("src").applyInPandas(first_fit, "tail_src string, tail_place bigint, fits boolean").where("fits"), "fits")
    body = near(rows).where(~in_tail).withColumn("extra", (F.col("block") < F.col("ends")).cast("int"))
    last = near(rows).where(in_tail).join(fits, F.col("src").eqNullSafe(F.col("tail_src")) & (F.col("place") == F.col("tail_place")), "left").withColumn("extra", F.coalesce(F.col("fits").cast("int"), F.lit(0))).select(body.columns)
    both = body.unionByName(last)
    return both.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0)).drop("src", "whole", "extra", "ends", "tail", "due")


#: ``shards``: their number, or None for one to every ``shard_words`` words, 65,536 at most.
SETTINGS = {"weights": (5, 2, 1), "most": 3.0, "seed": 17, "shards": None, "shard_words": 2_000_000, "max_sources": 10_000, "max_cells": 1 << 20}


def drawn(rows: DataFrame, mix: Mix, seed: int) -> DataFrame:
    """rows (with source, block and copies) with ``shards``: for each copy the shard that draws it, by the tree's quotas and each source's random order."""
    rank, starts, blocks = {r[0]: i for i, r in enumerate(mix.table)}, np.cumsum(mix.quotas, axis=1), mix.blocks
    rng = np.random.Generator(np.random.PCG64(seed + 2))
    order = [rng.permutation(int(n)).astype(np.int32) for n in mix.quotas.sum(axis=1)]  # in which the blocks due from a source are drawn
    index = F.broadcast(rows.sparkSession.createDataFrame([(s, i) for s, i in rank.items()], "src string, src_rank int"))

    @F.pandas_udf("array<int>")
    def shards_of(source: pd.Series, block: pd.Series, copies: pd.Series) -> pd.Series:
        n = copies.to_numpy(np.int64)
        own, ends = np.repeat(source.to_numpy(np.int64), n), np.cumsum(n)
        slot = np.repeat(block.to_numpy(np.int64), n) + (np.arange(len(own)) - np.repeat(ends - n, n)) * blocks
        out = np.full(len(own), -1, np.int32)
        for s in np.unique(own):
            at = np.flatnonzero((own == s) & (slot < len(order[s])))  # a slot beyond the source's quota is drawn by no shard
            out[at] = np.searchsorted(starts[s], order[s][slot[at]], side="right")
        return pd.Series([x[x >= 0] for x in np.split(out, ends)[:-1]], dtype=object)

    each = rows.join(index, F.col("source").cast("string").eqNullSafe(F.col("src")), "left").drop("src")
    return each.withColumn("shards", shards_of(F.coalesce("src_rank", F.lit(0)), "block", "copies")).drop("src_rank")


def taken(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, and ``shards``, those that drew it; what they drew is counted."""
    settings = SETTINGS | settings
    rows = written(sized(docs, settings["seed"]), "sizes")
    mix = plan(rows, **settings)
    out = drawn(copies(rows, rows, mix), mix, settings["seed"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("bigint").alias("taken"), "shards")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of the mix, a document as often as it is taken, with ``shard`` and ``turn`` (its order within the shard)."""
    return rows_and_shards(docs, settings)[0]


def rows_and_shards(docs: DataFrame, settings: dict) -> tuple[DataFrame, int]:
    settings = SETTINGS | settings
    base = without(docs, "shard", "turn")
    rows = written(sized(base, settings["seed"]), "sizes")
    mix = plan(rows, **settings)
    each = sized(base.select("doc_id", "source", "text", F.struct(*quoted(base)).alias("__row")), settings["seed"], "__row")
    each = drawn(copies(each, rows, mix).where("copies > 0"), mix, settings["seed"])
    each = each.select("*", F.posexplode("shards").alias("at", "shard")).withColumn("turn", F.xxhash64(F.lit(settings["seed"] + 1), "place", F.col("at") + 1))
    return each.select("__row.*", "shard", "turn"), mix.quotas.shape[1]


def mix_rows(docs: DataFrame, **settings) -> DataFrame:
    """The mix in its order: each shard together, shuffled within."""
    rows, shards = rows_and_shards(docs, settings)
    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "turn").select(quoted(docs))
