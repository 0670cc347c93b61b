"""1 N-gram Jaccard join: a MinHash LSH forest finds candidates, exact verification keeps pairs of Jaccard similarity at or above the threshold.

Every text has one label in each of ``trees`` prefix tries: ``depth`` MinHash values in order. Texts that share a prefix of
their labels in some trie are candidates. The prefix starts at the whole label and is shortened until two texts of exactly
the threshold share one in some trie with the target recall; more similar ones share it more often. Copies (the same words)
are one node. Candidates are grouped by connected prefixes, and within a group all pairs are verified on the exact shingle
sets, in blocks of ``block`` texts, so no list of pairs is ever made; small groups share a block. A block gives back each
text's links and one link to its class.

Result: doc_id, class_id (the smallest doc_id of the class), n_links (other documents of similarity at or above the threshold,
copies included). Repeated rows count as copies. Documents without a word, null texts included, are classes of their own
with no links (class_id is their doc_id). A class whose doc_ids are all null has a null class_id. Shingles are compared by
64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import giving_back, quoted, skew_safe_join, slices, written
from evenhand.llm.graph import components
from evenhand.llm.shingles import mix, shingles, word_hashes


def prefix_length(threshold: float, trees: int, depth: int, target: float) -> int:
    """Shorten the prefix until a pair at the threshold is found with the target recall."""
    for n in range(depth, 0, -1):
        if 1 - (1 - threshold**n) ** trees >= target:
            return n
    raise ValueError("even single values don't reach the target recall: more trees are needed")


def labels(texts: list[str | None], k: int, trees: int, prefix: int) -> tuple[list[bytes | None], np.ndarray]:
    """A digest of each text's words (None without words), and its prefix in each trie as one number."""
    words, counts = word_hashes(texts)
    cut = np.concatenate([[0], np.cumsum(counts)])
    digests = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(cut, cut[1:], strict=False)]
    h, n = shingles(words, counts, k)
    some = np.flatnonzero(n)
    keys = np.zeros((len(texts), trees), np.uint64)
    if not len(some):
        return digests, keys
    x = (h >> np.uint64(32)).astype(np.uint32)
    starts = (np.cumsum(n) - n)[some]
    seed = mix(np.arange(1, 2 * trees * prefix + 1, dtype=np.uint64))
    odd, flip = seed[::2].astype(np.uint32) | np.uint32(1), seed[1::2].astype(np.uint32)
    buf = np.empty_like(x)
    for t in range(trees):
        key = np.full(len(some), np.uint64(t + 1))
        for j in range(t * prefix, (t + 1) * prefix):
            np.bitwise_xor(x, flip[j], out=buf)
            np.multiply(buf, odd[j], out=buf)
            key = mix(key + np.minimum.reduceat(buf, starts))
        keys[some, t] = key
    return digests, keys


def overlaps(h: np.ndarray, own: np.ndarray, n: int, dense: int = 24, columns: int = 4096) -> np.ndarray:
    """The number of shingles that each two of n texts share; (h, own) are the shingles and their texts, without repeats."""
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(h)))
    out = np.zeros((n, n), np.int64)
    for m in np.unique(count[(count > 1) & (count <= dense)]):
        among = own[start[count == m][:, None] + np.arange(m)]
        a, b = np.triu_indices(m, 1)
        for part in np.array_split(among, 1 + among.shape[0] * len(a) // (1 << 21)):
            code = np.minimum(part[:, a], part[:, b]) * n + np.maximum(part[:, a], part[:, b])
            out += np.bincount(code.ravel(), minlength=n * n).reshape(n, n)
    many = np.flatnonzero(count > dense)
    for at in range(0, len(many), columns):
        own_columns = many[at : at + columns]
        x = np.zeros((n, len(own_columns)), np.float32)
        for c, i in enumerate(own_columns):
            x[own[start[i] : start[i] + count[i]], c] = 1
        out += np.triu(np.rint(x @ x.T).astype(np.int64), 1)
    return out + out.T


def verify_block(digests: list[bytes], weight: np.ndarray, side: np.ndarray, texts: list[str], k: int, threshold: float) -> tuple[list[bytes], list[bytes], list[int]]:
    """Of each text of a block: its digest, the digest that stands for its class in this block, and its links. ``side``: 0 for
    blocks against themselves, else 1 and 2, and only pairs across count."""
    words, counts = word_hashes(texts)
    h, n = shingles(words, counts, k)
    own = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])) if len(h) else np.zeros(0, bool)
    h, own = h[new], own[new]
    size = np.bincount(own, minlength=len(texts))
    shared = overlaps(h, own, len(texts))
    linked = (shared > 0) & (shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9)
    np.fill_diagonal(linked, False)
    if side.any():
        linked &= side[:, None] != side[None, :]
    links = linked @ weight
    root = np.arange(len(texts))
    while True:
        best = np.minimum(root, np.where(linked, root[None, :], len(texts)).min(axis=1, initial=len(texts)))
        best = best[best]
        if (best == root).all():
            break
        root = best
    return digests, [digests[r] for r in root], links.tolist()


def classify(docs: DataFrame, threshold: float = 0.8, k: int = 5, trees: int = 40, depth: int = 8, target: float = 0.99999, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """Two written tables: doc_id, rid and digest of every row; and each digest's copies n, links and the head (first document) of its class."""
    prefix = prefix_length(threshold, trees, depth, target)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    id_type = rows.dtypes[0][1]

    def sign(batches):
        for batch in slices(batches, "text", 4 << 20):
            digests, keys = labels(batch.column("text").to_pylist(), k, trees, prefix)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * trees, pa.int32()), pa.array(keys.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(digests, pa.binary()), lists], names=["doc_id", "rid", "digest", "keys"])

    signed = written(rows.mapInArrow(giving_back(sign), f"doc_id {id_type}, rid bigint, digest binary, keys array<bigint>"), "signed")
    nodes = written(signed.where("digest is not null").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("head"), F.count("*").alias("n"), F.first("keys").alias("keys")), "nodes")

    prefixes = nodes.select("digest", F.explode("keys").alias("key"))
    shared = written(prefixes.groupBy("key").agg(F.count("*").alias("n"), F.min("digest").alias("least")).where("n > 1").select("key", "least"), "prefixes")
    near = prefixes.join(shared, "key").where(F.col("digest") != F.col("least"))
    groups = written(components(near.select(F.col("digest").alias("a"), F.col("least").alias("b"))), "candidates")

    sizes = written(groups.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    small = F.col("size") <= block // 2
    parts = F.ceil(F.col("size") / block).cast("int")
    bins = max(1, (groups.count() * 2) // block)
    spread = F.concat(F.lit("~").cast("binary"), F.col("node"))
    placed = skew_safe_join(groups.withColumnRenamed("root", "key"), sizes.withColumnRenamed("root", "key"), "key", "size", spread)
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    other = F.explode(F.when(small, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), parts - 1)))
    placed = placed.select("node", "key", "size", F.when(small, F.lit(0)).otherwise(own).alias("own"), other.alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    place = F.when(small, F.concat(F.lit("b"), F.pmod(F.xxhash64("key"), F.lit(bins)).cast("string"))).otherwise(F.concat_ws(".", F.hex("key"), low, high))
    side = F.when(small | (F.col("own") == F.col("other")), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    placed = placed.select(F.col("node").alias("digest"), place.alias("place"), side.cast("int").alias("side"))
    todo = placed.join(nodes.select("digest", "head.rid", "n"), "digest")

    def verify(table: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        got = verify_block(table.column("digest").to_pylist(), np.array(table.column("n").to_pylist(), np.int64), np.array(table.column("side").to_pylist()), texts, k, threshold)
        return pa.table([pa.array(got[0], pa.binary()), pa.array(got[1], pa.binary()), pa.array(got[2], pa.int64())], names=["a", "b", "links"])

    texts = rows.select("rid", "text").join(todo, "rid").dropDuplicates(["rid", "place"])  # repeated rows of one document: one is enough
    found = written(texts.groupBy("place").applyInArrow(verify, "a binary, b binary, links bigint"), "verified")
    links = found.groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b")).withColumnRenamed("node", "digest")

    per_node = nodes.select("digest", "head", "n").join(links, "digest", "left").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest")).withColumn("links", F.coalesce("links", F.lit(0)))
    per_node = written(per_node, "nodes")
    heads = written(per_node.groupBy(F.col("root").alias("key")).agg(F.min("head").alias("first"), F.count("*").alias("m")).where("m > 1"), "heads")
    named = skew_safe_join(per_node.withColumnRenamed("root", "key"), heads, "key", "m", F.concat(F.lit("~").cast("binary"), F.col("digest")))
    named = named.select("digest", "n", F.coalesce("first", "head").alias("head"), (F.col("links") + F.col("n") - 1).alias("n_links"))
    return signed.select("doc_id", "rid", "digest"), written(named, "named")


def classes(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    rows, named = classify(docs, **parameters)
    own = F.concat(F.lit("~").cast("binary"), F.col("rid").cast("string").cast("binary"))  # spreads rows without a digest
    each = rows.select("doc_id", "rid", F.coalesce("digest", own).alias("digest"), F.col("digest").isNull().alias("blank"))
    out = skew_safe_join(each, named.select("digest", "n", F.col("head.doc_id").alias("class_id"), "n_links"), "digest", "n", own)
    return out.select("doc_id", F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def first_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """One document of each class stays, its head: the smallest doc_id. Documents without a word all stay; rows repeated with their doc_id stay once."""
    rows, named = classify(docs, **parameters)
    kept = named.select("head.rid").unionByName(rows.where("digest is null").select("rid")).distinct()
    return docs.withColumn("__rid", F.xxhash64("doc_id", "text")).join(kept.withColumnRenamed("rid", "__rid"), "__rid", "left_semi").dropDuplicates(["__rid"]).select(quoted(docs))
