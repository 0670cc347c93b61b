"""5 Substring dedup: lines and their sentences are normalised and hashed, digests grouped over all documents, the earliest occurrence kept.

A text is cut into units that cover it: sentences, which end at ``.``, ``!``, ``?``, their wide forms or the line's end. A unit's
normal form is in lower case with single spaces. Occurrences rank by (doc_id, offset); every one but the first is a repeat.
Neighbouring repeats form a run, and a run goes when one of its units has ``min_words`` words or more, or when it holds a
passage of shorter units that stands in the same order in an earlier document; short sentences which any two texts may share
by chance stay otherwise. Words are parted by spaces; letters of scripts that are written without spaces count as words.
Removed runs are given as offsets (code points) in the original text.

Passages of over ``passage_words`` words are found wherever they begin and end: at most ``min_words`` - 1 words of the short unit
at either end fall outside of whole units, so from each short unit on, the fewest units with more than
``passage_words`` - 2 (``min_words`` - 1) words get a digest of their own, which is grouped like those of the units. Any
longer passage of short units that two documents share holds one of these at the same place.

Defined results: null and empty texts have no units; rows with the same doc_id count as one document and aren't compared
with each other, nor are rows without a doc_id that hold equal texts; rows without a doc_id rank last; no row is lost.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import giving_back, quoted, skew_safe_join, slices, without, written

UNIT = re.compile(r"[^.!?。！？｡\n]+[.!?。！？｡\n]*[ \t\r\n]*|[.!?。！？｡\n]+[ \t\r\n]*")
GAP = re.compile(r"[ \t\r\n]+")
# Scripts written without spaces (Unicode ranges, fixed values): Thai and Lao, Burmese, Khmer, Kana, Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
NO_ID = 1 << 62


def own_id() -> Column:
    """doc_id; rows without one get a number beyond all ids from their text."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(NO_ID))


def word_count(normal: str) -> int:
    """Words of a normal form: letters of unspaced scripts count as one each."""
    if normal.isascii() or not UNSPACED.search(normal):
        return normal.count(" ") + 1
    return sum(max(1, sum(map(str.isalpha, UNSPACED.findall(w)))) for w in normal.split(" "))


def passages(short: list[tuple[bytes, int, int, int]], least: int) -> list[tuple[bytes, int, bool]]:
    """From each of neighbouring short units (digest, start, stop, words) on, the fewest that have more than ``least`` words together, as from cut()."""
    out, stop, words = [], 0, 0
    digests = b"".join(u[0] for u in short)
    for i, u in enumerate(short):
        while words <= least and stop < len(short):
            words += short[stop][3]
            stop += 1
        if words <= least:
            break
        out.append((xxhash.xxh3_128_digest(digests[16 * i : 16 * stop]), u[1] << 32 | (short[stop - 1][2] - u[1]) << 1 | 1, False))
        words -= u[3]
    return out


def cut(text: str, min_words: int, passage_words: int) -> list[tuple[bytes, int, bool]]:
    """Digest, place and whether it occurred before in the text, for each unit; behind them the same for passages of short units,
    which are compared with other documents only. The place packs offset, length and whether it is a passage or a long unit."""
    least = max(0, passage_words - 2 * (min_words - 1))
    seen: set[bytes] = set()
    out, longer, short = [], [], []
    for m in UNIT.finditer(text):
        normal = GAP.sub(" ", m.group()).strip(" ").lower()
        start, stop = m.span()
        words = word_count(normal) if normal else 0
        if normal:
            digest = xxhash.xxh3_128_digest(normal.encode("utf-8", "replace"))
            out.append((digest, start << 32 | (stop - start) << 1 | (words >= min_words), digest in seen))
            seen.add(digest)
        if 0 < words < min_words:
            short.append((digest, start, stop, words))
        elif short:
            longer += passages(short, least)
            short = []
    return out + longer + passages(short, least)


def units(docs: DataFrame, min_words: int, passage_words: int) -> DataFrame:
    """id, h1, h2 (the digest), place, again; of units and of passages."""

    def run(batches):
        for batch in slices(batches, "text", 2 << 20):
            n, found = [], []
            for t in batch.column("text").to_pylist():
                got = cut(t, min_words, passage_words) if t else []
                n.append(len(got))
                found += got
            h = np.frombuffer(b"".join(f[0] for f in found), np.int64).reshape(-1, 2)
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.array([f[1] for f in found], np.int64)), pa.array(np.array([f[2] for f in found], bool))], names=["id", "h1", "h2", "place", "again"])

    return docs.select(own_id().alias("id"), "text").mapInArrow(giving_back(run), "id bigint, h1 bigint, h2 bigint, place bigint, again boolean")


def joined_runs(places: np.ndarray) -> list[dict]:
    """Runs of neighbouring places that hold a long unit or a passage, as offsets."""
    places = np.unique(places)
    start, size, long = places >> 32, (places & 0xFFFFFFFF) >> 1, (places & 1).astype(bool)
    stop = np.maximum.accumulate(start + size)  # a passage covers units
    first = np.flatnonzero(np.append(True, start[1:] > stop[:-1]))
    keep = np.logical_or.reduceat(long, first)
    ends = stop[np.append(first[1:], len(places)) - 1]
    return [{"start": int(a), "stop": int(b)} for a, b, k in zip(start[first], ends, keep, strict=True) if k]


def repeat_spans(docs: DataFrame, min_words: int = 8, passage_words: int = 50) -> DataFrame:
    """id and spans (array<struct<start, stop>>) of documents with something to remove; ``id`` is own_id() of the rows."""
    cuts = units(docs, min_words, passage_words)
    first = cuts.where(~F.col("again")).groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    shared = written(first.where("first < last").select("h1", "h2", "first", "n"), "shared_units")
    across = skew_safe_join(cuts.where(~F.col("again")).select("id", "h1", "h2", "place"), shared, ["h1", "h2"], "n", F.xxhash64("id", "place"))
    repeats = across.where(F.col("id") > F.col("first")).select("id", "place").unionByName(cuts.where("again").select("id", "place"))
    lists = repeats.groupBy("id").agg(F.collect_list("place").alias("places"))

    def run(batches):
        for batch in batches:
            ids, spans = [], []
            for i, p in zip(batch.column("id").to_pylist(), batch.column("places"), strict=True):
                if got := joined_runs(np.array(p.values)):
                    ids.append(i)
                    spans.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["id", "spans"])

    return lists.mapInArrow(giving_back(run), "id bigint, spans array<struct<start:int,stop:int>>")


def removed(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """doc_id, start and stop of every removed run."""
    spans = repeat_spans(docs, min_words).select(F.when(F.col("id") < NO_ID, F.col("id")).alias("doc_id"), F.explode("spans").alias("s"))
    return spans.select("doc_id", "s.start", "s.stop")


def remove_repeats(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """docs without their repeats: ``text`` is what stays, ``n_chars`` its length if there is such a column; documents of which
    nothing but white space stays go, those that had no text before stay."""
    spans = written(repeat_spans(docs, min_words), "repeat_spans")
    base = docs.withColumn("__id", own_id()).join(spans.select(F.col("id").alias("__id"), F.col("spans").alias("__spans")), "__id", "left")
    pieces = F.transform(
        F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("__spans.stop")).alias("a"), F.concat(F.col("__spans.start"), F.array(F.length("text"))).alias("b")),
        lambda s: F.substring(F.col("text"), s["a"] + 1, s["b"] - s["a"]),
    )
    base = base.withColumn("__text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.concat_ws("", pieces)))
    base = base.where(F.col("__spans").isNull() | (F.regexp_replace("__text", r"\s+", "") != ""))
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast("bigint")}
    return base.select([new[c].alias(c) if c in new else F.col(q) for c, q in zip(docs.columns, quoted(docs), strict=True)])


#: The same in SQL for runs with a long unit: passages of short units alone, and words and sentences of unspaced scripts, are not in it. Null doc_ids are not told apart here; the given tables have none.
SQL = r"""with u0 as (select doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?\n]*[ \t\r\n]*|[.!?\n]+[ \t\r\n]*') us from documents where text is not null),
 u1 as (select doc_id, unnest(us) unit, unnest(range(len(us))) i from u0),
 u as (select *, coalesce(sum(length(unit)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) s0 from u1),
 n as (select doc_id, i, s0, s0 + length(unit) s1, lower(trim(regexp_replace(unit, '[ \t\r\n]+', ' ', 'g'), ' ')) f from u),
 w as (select *, len(string_split(f, ' ')) >= 8 long, row_number() over (partition by f order by doc_id, i) k from n where f <> ''),
 r as (select * , i - row_number() over (partition by doc_id order by i) g from w where k > 1),
 runs as (select doc_id, g, min(s0) s0, max(s1) s1, bool_or(long) long from r group by 1, 2)
select doc_id, cast(s0 as int) as start, cast(s1 as int) as stop from runs where long"""
