"""7 Token ids as binary files: one id array per segment, with Elias-Fano coded document boundaries.

Segment layout (little endian): the magic ``EHT1``; id width in bytes (u32); documents, ids, documents without a doc_id, and
ids of the part before this segment (u64 each); the boundaries (start of each document and the end) and the doc_ids of the
other documents, each as an Elias-Fano sequence; then all ids. A sequence of n ascending numbers below u holds
floor(log2(u / n)) low bits of each number as they are, and the high bits in unary: the i-th number's bit stands at (high bits) + i. To
find the i-th set bit, the place of every 256th one is kept in 32 bits, so a boundary costs at most 3 + log2(u / n) bits and an eighth
of one, not 64.

Segments are rows of a Parquet table (part, seq, payload), so that any file system and commit protocol that Spark knows serves
and a lost task is simply run again. Parts follow one another in doc_id order, and so do segments within a part.

Defined results: null text is an empty text and gives the end id alone; documents without a doc_id come first; equal doc_ids are
ordered by the hash of their text; an empty table gives no segment and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm.bpe import Transducer, load
from evenhand.llm.common import scratch_path, slices

SIGNS = "!\"#$%&()*+,-./:;=?@[\\]^`{|}~"  # signs that always are one piece with their neighbours (no apostrophe, no part of a special token's string)
MAGIC, HEAD, SAMPLE = b"EHT1", "<4sIQQQQ", 256


class LibraryCoder(Transducer):
    """The same store of words in front of the tokenizers library, which encodes every word that isn't in it. Cutting at white
    space and lower case of ASCII text change no id of vocabularies whose pieces hold no white space and whose normaliser is in lower case."""

    def __init__(self, spec: dict, kept: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        super().__init__(spec, kept)
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.library.no_truncation()
        self.library.no_padding()
        self.cut = None
        self.shown = {b: c for b, c in enumerate(self.letters) if c != chr(b)}

    def normal(self, text: str) -> str:
        return text.lower() if self.lower and text.isascii() else text

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Letters with signs behind them are two pieces, each looked up by itself. A piece of letters goes to the library's model
        directly, as its normaliser leaves it and with bytes shown as letters; all else goes through the whole library."""
        parts = []
        for w in new:
            stem = w.rstrip(SIGNS)
            parts.append((stem, w[len(stem) :]) if len(stem) < len(w) and stem.isalpha() else (w,))
        ids: dict[str, bytes] = {}
        other, tokenize, known = [], self.library.model.tokenize, self.words
        for p in {p for own in parts for p in own}:
            if (got := known.get(p)) is not None:
                ids[p] = got
                continue
            q = super().normal(p)
            if q.isalpha() and len(q) < self.window:
                ids[p] = self.packed([t.id for t in tokenize(q if q.isascii() else q.encode().decode("latin-1").translate(self.shown))])
            else:
                other.append(p)
        ids.update(zip(other, (self.packed(e.ids) for e in self.library.encode_batch(other, add_special_tokens=False)), strict=True))
        known.update((own[0], ids[own[0]]) for own in parts if len(own) > 1)
        return {w: b"".join([ids[p] for p in own]) for w, own in zip(new, parts, strict=True)}


def pack_bits(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


@dataclass
class EliasFano:
    """n ascending numbers below u."""

    n: int
    u: int
    low_bits: int
    low: np.ndarray  # bytes
    high: np.ndarray  # bytes
    samples: np.ndarray  # places of every SAMPLE-th set bit, u32

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, u = len(values), int(values[-1]) + 1 if len(values) else 1
        width = max(0, (u // max(1, n)).bit_length() - 1)
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, u, width, np.frombuffer(pack_bits(values & np.uint64((1 << width) - 1), width), np.uint8), np.packbits(high, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack("<QQIQQQ", self.n, self.u, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, buf: memoryview, at: int) -> tuple[EliasFano, int]:
        n, u, width, a, b, c = struct.unpack_from("<QQIQQQ", buf, at)
        at += struct.calcsize("<QQIQQQ")
        return cls(n, u, width, np.frombuffer(buf, np.uint8, a, at), np.frombuffer(buf, np.uint8, b, at + a), np.frombuffer(buf, "<u4", c, at + a + b)), at + a + b + 4 * c

    def lows(self, i: int, j: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(j - i, np.uint64)
        a, b = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(j - i, self.low_bits)
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """The i-th number, from one sample on."""
        start = int(self.samples[i // SAMPLE])
        stop = int(self.samples[i // SAMPLE + 1]) + 1 if i // SAMPLE + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :]
        at = start + int(np.flatnonzero(bits)[i % SAMPLE])
        return (at - i) << self.low_bits | int(self.lows(i, i + 1)[0])

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(0, self.n)


def write_segment(docs: list[tuple[int | None, bytes]], width: int, before: int) -> bytes:
    """One segment of (doc_id, packed ids) in order, documents without a doc_id first."""
    size = np.array([len(p) // width for _, p in docs], np.int64)
    named = np.array([d for d, _ in docs if d is not None], np.int64).astype(np.uint64) ^ np.uint64(1 << 63)  # ascending also below zero
    first = named[:1]
    ends = EliasFano.of(np.concatenate([[0], np.cumsum(size)])).to_bytes()
    names = struct.pack("<Q", int(first[0]) if len(first) else 0) + EliasFano.of(named - first if len(first) else named).to_bytes()
    return struct.pack(HEAD, MAGIC, width, len(docs), int(size.sum()), len(docs) - len(named), before) + ends + names + b"".join(p for _, p in docs)


def read_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """doc_ids, boundaries, ids, and the number of ids of the part before the segment."""
    buf = memoryview(payload)
    magic, width, n, n_ids, unnamed, before = struct.unpack_from(HEAD, buf)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    ends, at = EliasFano.read(buf, struct.calcsize(HEAD))
    (first,) = struct.unpack_from("<Q", buf, at)
    names, at = EliasFano.read(buf, at + 8)
    ids = np.frombuffer(buf, "<u2" if width == 2 else "<u4", n_ids, at)
    named = ((names.all() + np.uint64(first)) ^ np.uint64(1 << 63)).astype(np.int64)
    return [None] * unnamed + named.tolist(), ends.all().astype(np.int64), ids, before


def write_tokens(docs: DataFrame, path: str, to: str, end_id: int = 2, segment_ids: int = 1 << 20, parts: int | None = None) -> None:
    """Encode every text, append ``end_id``, and write segments of about ``segment_ids`` ids in ascending doc_id order to ``to``.

    Parts are ranges of doc_id between quantiles, found on the doc_id column alone, so that texts are encoded once; the edges
    only balance the work, and there are as many as ``parts`` (four to a shuffle partition) at most."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or min(4 * tasks, 100_000)
    edges = np.unique(docs.select(F.col("doc_id").cast("bigint").alias("d")).approxQuantile("d", [i / parts for i in range(1, parts)], 0.2 / parts)).astype(np.int64) if parts > 1 else np.zeros(0, np.int64)
    sent = spark.sparkContext.broadcast((load(path), edges))

    def encode(batches):
        spec, at = sent.value
        coder = LibraryCoder(spec)
        end = coder.packed([end_id])
        for batch in slices(batches, "text", 4 << 20):
            ids = batch.column("doc_id").to_pylist()
            part = np.searchsorted(at, np.array([i or 0 for i in ids], np.int64), side="right")
            part[[i is None for i in ids]] = -1
            packed = [p + end for p in coder.encode_all(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column("doc_id"), batch.column("tie"), pa.array(packed, pa.binary())], names=["part", "doc_id", "tie", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    coded = rows.mapInArrow(encode, "part int, doc_id bigint, tie bigint, ids binary").repartition(tasks, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "tie")

    def write(batches):
        width = 2 if max(chain(sent.value[0]["model"]["vocab"].values(), (t["id"] for t in sent.value[0]["added_tokens"]))) < 1 << 16 else 4
        part, seq, before, held, size = None, 0, 0, [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([write_segment(held, width, before)], pa.binary())], names=["part", "seq", "n_ids", "payload"])

        for batch in batches:
            for p, d, ids in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if held and (p != part or size >= segment_ids):
                    yield row()
                    seq, before, held, size = (seq + 1, before + size, [], 0) if p == part else (0, 0, [], 0)
                part = p
                held.append((d, ids))
                size += len(ids) // width
        if held:
            yield row()

    coded.select("part", "doc_id", "ids").mapInArrow(write, "part int, seq int, n_ids bigint, payload binary").write.parquet(to)


def read_tokens(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the crc32 of its ids as unsigned 32-bit numbers, from the files."""
    table = spark.read.schema("part int, seq int, n_ids bigint, payload binary").parquet(at)
    totals = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a number a part
    starts = dict(zip([p for p, _ in totals], np.cumsum([0, *[n for _, n in totals]])[:-1].tolist(), strict=True)) if totals else {}
    sent = spark.sparkContext.broadcast(starts)

    def read(batches):
        for batch in batches:
            for part, payload in zip(batch.column("part").to_pylist(), batch.column("payload"), strict=True):
                names, ends, ids, before = read_segment(payload.as_buffer())
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ends[:-1] + (before + sent.value[part])), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.select("part", "payload").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def written_and_read(docs: DataFrame, path: str) -> DataFrame:
    to = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, to)
    return read_tokens(docs.sparkSession, to)
