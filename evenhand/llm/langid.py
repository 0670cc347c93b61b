"""10 Language ID: scripts narrow the candidate languages, then Viterbi over per-word scores with a penalty for each switch labels spans.

Learning: letter n-grams of the words of labelled documents, hashed to a table of fixed size, are counted per language on
Spark, over all labelled rows that are not held out (or, if ``sample_rows`` is given, over about so many, each in or out by the
hash of its doc_id); the model has a fixed size at every input size. Prediction reads the text alone.

Defined results: null text, empty text or text without a letter gives ``und`` with score 0 and no spans; a null doc_id is
never learned from and not held out; repeated rows get the same answer each; equal scores go to the language that is first
by code point; with no labelled rows everything is ``und``. Input columns named as the results are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import giving_back, quoted, slices, without, written

SPANS = "array<struct<start:int,stop:int,lang:string>>"
RESULT = ["lang_pred", "score", "spans"]
BUCKETS = 1 << 16  # the top 16 bits of a hash
# Unicode ranges of scripts (fixed values).
SCRIPTS = [
    ("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x77F),
    ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Tamil", 0xB80, 0xBFF), ("Thai", 0xE00, 0xE7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF),
    ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
]
LETTERS = regex.compile(r"[\p{L}\p{M}]*\p{L}[\p{L}\p{M}]*")  # letters with their marks; no digits, fractions or number signs


def script_of(word: str) -> str:
    """The script of a word's first letter."""
    c = ord(word[0])
    return next((name for name, lo, hi in SCRIPTS if lo <= c <= hi), "other")


def grams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of one to four letters of each piece, its ends included, and the index of the piece that each belongs to."""
    c = np.frombuffer(("<" + "><".join(pieces) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
    own = np.cumsum(c == ord("<")) - 1
    found, whose = [], []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, 5):
        m = len(c) - n + 1
        h = h[:m] * np.uint64(1000003) + c[n - 1 :] + np.uint64(n)
        inside = own[:m] == own[n - 1 :]
        x = h[inside]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9E3779B97F4A7C15)
        found.append((x >> np.uint64(48)).astype(np.int64))
        whose.append(own[:m][inside])
    return np.concatenate(found), np.concatenate(whose)


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (BUCKETS, languages)
    scripts: dict[str, np.ndarray]  # candidates of each script


def held_out(doc_id: str = "doc_id"):
    """Rows that are not learned from: those whose crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned_from():
    """Rows with a label that are not held out."""
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()


def labelled_rows(docs: DataFrame, sample_rows: int | None) -> DataFrame:
    """All labelled rows that are not held out, or about ``sample_rows`` of them."""
    labelled = docs.select("doc_id", "text", "lang").where(learned_from())
    if sample_rows is None:
        return labelled
    n = labelled.count()
    share = min(1.0, sample_rows / max(1, n))
    return labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit(docs: DataFrame, sample_rows: int | None = None, max_langs: int = 64) -> Model:
    """Counts over all labelled rows, or about ``sample_rows`` of them; more than ``max_langs`` languages are an error."""
    part = labelled_rows(docs, sample_rows)

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        scripts: Counter = Counter()
        for batch in slices(batches, "text"):
            words: dict[str, Counter] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            for lang, seen in words.items():
                table = tables.setdefault(lang, np.zeros(BUCKETS))
                for w, k in seen.items():
                    scripts[lang, script_of(w)] += k
                if seen:
                    bucket, whose = grams(list(seen))
                    table += np.bincount(bucket, weights=np.array(list(seen.values()), float)[whose], minlength=BUCKETS)
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array([""] * len(at)), pa.array(at, pa.int64()), pa.array(table[at])], names=["lang", "script", "bucket", "n"])
        if scripts:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in scripts]), pa.array([k[1] for k in scripts]), pa.array([-1] * len(scripts), pa.int64()), pa.array([float(v) for v in scripts.values()])], names=["lang", "script", "bucket", "n"])

    counts = part.mapInArrow(giving_back(count), "lang string, script string, bucket bigint, n double").groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, script, bucket, k = (counts.column(c).to_pylist() for c in ("lang", "script", "bucket", "n"))
    langs = sorted(set(lang))
    if len(langs) > max_langs:
        raise ValueError(f"{len(langs)} languages; max_langs is {max_langs}")
    at = {x: i for i, x in enumerate(langs)}
    table = np.full((BUCKETS, max(1, len(langs))), 0.5)
    letters: dict[str, np.ndarray] = {}
    for x, s, b, v in zip(lang, script, bucket, k, strict=True):
        if b >= 0:
            table[b, at[x]] += v
        else:
            letters.setdefault(s, np.zeros(len(langs)))[at[x]] = v
    all_words = sum(letters.values()) if letters else None
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32), {s: v >= 0.01 * all_words for s, v in letters.items()})


class Words:
    """Scores of words, kept for words seen again; the store is emptied when it is full, so it never grows beyond ``most``."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.n = 1
        self.score = np.zeros((1 << 12, len(self.model.langs)), np.float32)
        self.whole = np.zeros((1 << 12, len(self.model.langs)), np.float32)  # log-likelihoods, not relative to the best language
        self.letters = np.zeros(1 << 12, np.int32)

    def add(self, new: list[str]) -> None:
        """Scores for words that are not in the store yet; words without a letter are number 0."""
        parts = [LETTERS.findall(w) for w in new]
        self.ids.update((w, 0) for w, p in zip(new, parts, strict=True) if not p)
        new, parts = [w for w, p in zip(new, parts, strict=True) if p], [p for p in parts if p]
        if not new:
            return
        pieces = [p for own in parts for p in own]
        word = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        bucket, whose = grams(pieces)
        per = np.bincount(whose, minlength=len(pieces))
        score = np.stack([np.bincount(whose, weights=self.model.logp[bucket, j], minlength=len(pieces)) for j in range(len(self.model.langs))], axis=1) / per[:, None]
        top = score.max(axis=1, keepdims=True)
        by_script: dict[str, list[int]] = {}
        for i, p in enumerate(pieces):
            by_script.setdefault(script_of(p), []).append(i)
        for script, at in by_script.items():
            ok = self.model.scripts.get(script)
            if ok is not None and ok.any():
                score[np.ix_(at, ~ok)] = top[at] - 20
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        whole = np.stack([np.bincount(word, weights=score[:, j] * size, minlength=len(new)) for j in range(score.shape[1])], axis=1)
        score = (score - score.max(axis=1, keepdims=True)) * np.minimum(size, 20)[:, None]
        total = np.stack([np.bincount(word, weights=score[:, j], minlength=len(new)) for j in range(score.shape[1])], axis=1)
        while self.n + len(new) > len(self.letters):
            self.score, self.whole, self.letters = (np.concatenate([x, np.zeros_like(x)]) for x in (self.score, self.whole, self.letters))
        self.score[self.n : self.n + len(new)] = np.maximum(total, -60)
        self.whole[self.n : self.n + len(new)] = whole
        self.letters[self.n : self.n + len(new)] = np.bincount(word, weights=size, minlength=len(new))
        self.ids.update(zip(new, range(self.n, self.n + len(new)), strict=True))
        self.n += len(new)

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """The numbers of all words of the texts, one behind another."""
        if len(self.ids) > self.most:
            self.clear()
        new: set[str] = set()
        for words in texts:
            new |= set(words).difference(self.ids)
        self.add(sorted(new))
        return np.fromiter((i for words in texts for i in map(self.ids.__getitem__, words)), np.int64, sum(map(len, texts)))


def viterbi(score: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; documents lie one behind another in score, and step together, longest first."""
    path = np.zeros(len(score), np.int16)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    n = int(np.searchsorted(-lengths, 0))  # documents with a word
    if not n:
        return path
    back = np.zeros(score.shape, np.int16)
    ends = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # documents that have a word t
    own = np.arange(score.shape[1], dtype=np.int16)
    v = score[starts[:n]].astype(np.float64)
    last = v.copy()
    for t in range(1, int(lengths[0])):
        k = ends[t]
        v = v[:k]
        best = v.argmax(axis=1)
        top = v[np.arange(k), best][:, None] - penalty
        stay = v >= top
        at = starts[:k] + t
        back[at] = np.where(stay, own, best[:, None])
        v = np.where(stay, v, top) + score[at]
        last[:k] = v
    now = last.argmax(axis=1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        k = ends[t]
        at = starts[:k] + t
        path[at] = now[:k]
        if t:
            now[:k] = back[at, now[:k]]
    return path


def label(texts: list[str | None], words: Words, penalty: float) -> list[tuple[str, float, list[dict], float | None]]:
    """Language, score, spans and fit of each text. The fit is the log-likelihood of an n-gram in that language, the mean over all letters; null without a letter. The score is the share of letters in that language, halved as far as another one fits the whole text as well."""
    langs = words.model.langs
    if not langs:
        return [("und", 0.0, [], None)] * len(texts)
    found = [t.lower().split() if t else [] for t in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(lengths) - lengths
    ids = words.of(found)
    del found
    path = viterbi(words.score[ids], starts, lengths, penalty)
    letters = words.letters[ids]
    out = []
    for text, a, n in zip(texts, starts, lengths, strict=True):
        own, w = path[a : a + n], letters[a : a + n]
        total = int(w.sum())
        if not total:
            out.append(("und", 0.0, [], None))
            continue
        share = np.bincount(own, weights=w, minlength=len(langs))
        best = int(share.argmax())
        s = words.score[ids[a : a + n]].sum(axis=0, dtype=np.float64)
        lead = s[best] - max((s[j] for j in range(len(langs)) if j != best), default=s[best] - 50)
        clear = 1 / (1 + math.exp(-max(-50.0, min(50.0, float(lead)))))
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), int(n)]
        if len(cuts) == 2:
            spans = [{"start": 0, "stop": len(text), "lang": langs[best]}]
        else:
            at = [m.start() for m in re.finditer(r"\S+", text)]
            at = at if len(at) == n else None  # lower case can't change the white space, but keep to whole text if it did
            edges = [0, *(at[c] for c in cuts[1:-1]), len(text)] if at else None
            spans = [{"start": edges[i], "stop": edges[i + 1], "lang": langs[own[cuts[i]]]} for i in range(len(cuts) - 1)] if at else [{"start": 0, "stop": len(text), "lang": langs[best]}]
        fit = float(words.whole[ids[a : a + n], best].sum(dtype=np.float64) / total)
        out.append((langs[best], float(share[best] / total * (1 + clear) / 2), spans, fit))
    return out


def identify(docs: DataFrame, model: Model, penalty: float = 12.0, with_fit: bool = False) -> DataFrame:
    """docs with ``lang_pred``, ``score`` (0 to 1), ``spans`` (code points from ``start`` to before ``stop``) and, if asked for, ``fit`` (the mean log-likelihood of an n-gram).

    The model has a fixed size (table buckets x languages) whatever the data, so it may travel with the tasks.
    """
    result = [*RESULT, "fit"] if with_fit else RESULT
    base = without(docs, *result)
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.scripts))
    names = base.columns
    text = next(i for i, c in enumerate(names) if c.lower() == "text")
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        words = Words(Model(*sent.value))
        for batch in slices(batches, names[text], 4 << 20):
            got = label(batch.column(text).to_pylist(), words, penalty)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], span_type), *([pa.array([g[3] for g in got], pa.float64())] if with_fit else [])], names=[*names, *result])

    schema = ", ".join(f"{q} {t}" for q, (_, t) in zip(quoted(base), base.dtypes, strict=True))
    return base.mapInArrow(giving_back(run), f"{schema}, lang_pred string, score double, spans {SPANS}{', fit double' if with_fit else ''}")


def predictions(docs: DataFrame) -> DataFrame:
    """The languages of all documents, learned from those that are not held out."""
    model = fit(docs)
    found = identify(docs.select("doc_id", F.col("text")), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def accept(docs: DataFrame, least: float = 0.2, sample_rows: int | None = None, slack: float = 2.0) -> DataFrame:
    """Documents in a known language. Those without a letter go, those of which no language holds a fair part (a score under ``least``), and those that fit
    their language by more than ``slack`` (a log-likelihood) worse than any labelled row of it does: foreign scripts and languages, random letters, encoded data."""
    found = written(identify(docs, fit(docs, sample_rows), with_fit=True).drop("spans"), "identified")  # predicted once; bars and results are read from it
    own = found.where(learned_from() & F.col("fit").isNotNull() & (F.col("lang_pred") == F.col("lang")))
    bars = {r["lang_pred"]: r["bar"] for r in own.groupBy("lang_pred").agg(F.min("fit").alias("bar")).collect()}  # a row a language
    bar = F.lit(float("inf"))
    for lang, worst in bars.items():
        bar = F.when(F.col("lang_pred") == lang, F.lit(worst - slack)).otherwise(bar)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least) & (F.col("fit") >= bar)).select(quoted(without(docs, *RESULT, "fit")))
