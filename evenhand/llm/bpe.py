"""3 BPE encoding and decoding: a streaming transducer with bounded lookahead, and an incremental byte-to-text machine.

Encoding. Text runs through the pieces of the vocabulary's own split pattern. Within a piece BPE merges by rank; a token is
stable once no text to its right can change it any more. How far to the right that can reach is computed from the merge
list alone (``sufficient_lookahead``): a merge (x, y) waits for y; y can be taken away only by a merge of a lower rank that
begins at y's right edge, which in turn waits for its own right part, and so on down the ranks. A piece longer than the
window is therefore merged window by window: tokens that end more than the lookahead before the window's end are
emitted, and the rest is merged again with the text that follows. Memory is bounded by the window however long a piece is.
Pieces that come again are looked up in a store of bounded size.

Letters are those of the installed Unicode tables; code points that newer tables added may fall into other pieces than in a
library with older ones.

Decoding. Token by token, bytes enter an incremental UTF-8 machine, which emits text as soon as characters are complete. With
``surface`` the token strings themselves are written with a space between them, as a tokenizer file without a decoder
asks for; otherwise byte-level tokens become bytes and word ends become spaces.

Defined results: null text counts as empty; empty text has no ids and decodes to empty text; special tokens' strings in the
text become their ids; repeated rows get equal rows; a null doc_id stays null; ids without a token are left out when decoding.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from evenhand.llm.common import giving_back, quoted, slices, without

RESULT = ["ids", "decoded"]
WHITE = regex.compile(r"\s+")
# Bytes that a byte-level vocabulary shows as themselves; the others follow from code point 256 on (fixed rule of such vocabularies).
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> list[str]:
    hidden = (b for b in range(256) if b not in set(SHOWN))
    table = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int:
    """Symbols to the right of a token after which it can't change.

    reach[r] bounds how far beyond the left part of merge r the text must be known to say that it happens: the right
    part's length, and whatever may take the right part's end away earlier. Merges that start with a token s and have a
    rank below r are kept in rank order with the running maximum of their reach.
    """
    parts = {x + y: (r, y) for r, (x, y) in reversed(list(enumerate(merges)))}
    ranks: dict[str, list[int]] = {}
    most: dict[str, list[int]] = {}
    longest = 0

    def taken(token: str, below: int) -> int:
        """The reach of what may take away the right end of a token before rank ``below``."""
        far = 0
        while True:
            if own := ranks.get(token):
                k = bisect_left(own, below)
                far = max(far, most[token][k - 1] if k else 0)
            if token not in parts or parts[token][0] >= below:
                return far
            below, token = parts[token]

    for r, (x, y) in enumerate(merges):
        reach = length[y] + taken(y, r)
        longest = max(longest, reach)
        ranks.setdefault(x, []).append(r)
        most.setdefault(x, []).append(max(reach, most[x][-1] if x in most and most[x] else 0))
    return longest


class Transducer:
    """The encoder of one vocabulary file."""

    def __init__(self, spec: dict, kept: int = 200_000):
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        steps = spec["normalizer"]
        kinds = [n["type"] for n in (steps["normalizers"] if steps and steps["type"] == "Sequence" else [steps] if steps else [])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        pre = spec["pre_tokenizer"]
        split = next(p for p in (pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]) if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        if split["behavior"] != "Removed" or not split["invert"] or self.pattern.search("a b\n").end() != 1:
            raise ValueError("the transducer is for vocabularies whose pieces hold no white space")
        self.letters = byte_letters()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        length = {c: 1 for c in self.letters} | {c + self.end: 1 for c in self.letters}
        for x, y in merges:
            length[x + y] = length[x] + length[y]
        self.length = length
        self.lookahead = sufficient_lookahead(merges, length)
        self.window = 4 * (self.lookahead + max(length.values()))
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.width = 2 if max(self.names) < 1 << 16 else 4
        self.kept = kept
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tables(merges)

    def tables(self, merges: list[tuple[str, str]]) -> None:
        """Merges by number, for many pieces at once; each merge must come after those that make its parts."""
        number = {t: i for i, t in enumerate(dict.fromkeys([*self.letters, *(c + self.end for c in self.letters), *(x + y for x, y in merges)]))}
        made = {c: -1 for c in number} | {x + y: r for r, (x, y) in reversed(list(enumerate(merges)))}
        if any(max(made[x], made[y]) >= r for r, (x, y) in enumerate(merges)):
            raise ValueError("a merge comes before one that makes its parts")
        self.n = len(number)
        keys = np.array([number[x] * self.n + number[y] for x, y in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, len(merges)).astype(np.int32)
        self.result = np.array([number[x + y] for x, y in merges] + [0], np.int32)
        self.first = np.array([number[c] for c in self.letters], np.int32)
        self.final = np.array([number[c + self.end] for c in self.letters], np.int32)
        self.ids_of = np.array([self.vocab.get(t, -1) for t in number], np.int64)

    def packed(self, ids: Iterable[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def merge(self, word: list[str]) -> list[str]:
        """Merge neighbours by rank, lowest first and from the left."""
        rank, none = self.rank, len(self.rank)
        pairs = [rank.get(p, none) for p in zip(word, word[1:], strict=False)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            word[i : i + 2] = [word[i] + word[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank.get((word[i - 1], word[i]), none)
            if i < len(pairs):
                pairs[i] = rank.get((word[i], word[i + 1]), none)
        return word

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one piece, each emitted once it is stable."""
        held: list[str] = []
        n = 0
        for s in symbols:
            held.append(s)
            n += 1
            if n >= self.window:
                tokens = self.merge(held.copy())
                done = size = 0
                while done < len(tokens) and size + self.length.get(tokens[done], 1) <= n - self.lookahead:
                    size += self.length.get(tokens[done], 1)
                    done += 1
                yield from tokens[:done]
                del held[:size]
                n -= size
        yield from self.merge(held)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.n + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.rank)).astype(np.int32)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of many short pieces, merged side by side: each round does every piece's lowest merge."""
        none, size = len(self.rank), np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw, own = np.frombuffer(b"".join(pieces), np.uint8), np.repeat(np.arange(len(pieces)), size)
        sym = self.first[raw]
        ends = np.cumsum(size) - 1
        sym[ends] = self.final[raw[ends]]
        rank = np.full(len(sym), none, np.int32)
        inside = np.flatnonzero(own[:-1] == own[1:])
        rank[inside] = self.rank_of(sym[inside], sym[inside + 1])
        done_sym, done_own = [], []
        while len(sym):
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            low = np.minimum.reduceat(rank, starts)
            low_each = np.repeat(low, np.diff(np.append(starts, len(sym))))
            over = low_each == none
            if over.any():
                done_sym.append(sym[over])
                done_own.append(own[over])
                go = ~over
                sym, own, rank, low_each = sym[go], own[go], rank[go], low_each[go]
                if not len(sym):
                    break
            hit = rank == low_each
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():  # a run of one symbol: every other pair, from the left
                run = np.flatnonzero(np.append(True, np.diff(at) != 1))
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            sym[at] = self.result[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            sym, own, rank = sym[keep], own[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                rank[i] = none
                i = i[i + 1 < len(sym)]
                i = i[own[i] == own[i + 1]]
                rank[i] = self.rank_of(sym[i], sym[i + 1])
        sym, own = np.concatenate(done_sym), np.concatenate(done_own)
        order = np.argsort(own, kind="stable")
        ids, own = self.ids_of[sym[order]], own[order]
        own = own[ids >= 0]
        buf = ids[ids >= 0].astype("<u2" if self.width == 2 else "<u4").tobytes()
        cut = [0, *(np.cumsum(np.bincount(own, minlength=len(pieces))) * self.width).tolist()]
        return [buf[i:j] for i, j in zip(cut, cut[1:], strict=False)]

    def long_piece(self, raw: bytes) -> bytes:
        last, letters = len(raw) - 1, self.letters
        return self.packed(self.vocab[t] for t in self.stream(letters[b] if i < last else letters[b] + self.end for i, b in enumerate(raw)) if t in self.vocab)

    def normal(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))  # letter by letter: no special final sigma
        return text

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """The packed ids of normal words."""
        find, parts = self.pattern.findall, []
        for w in new:
            if w.isalpha():
                parts.append((w,))
            elif w[-1] in ".,!?:;" and w[:-1].isalpha():
                parts.append((w[:-1], w[-1]))
            else:
                parts.append(find(w))
        pieces = list({p for own in parts for p in own})
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        short = [i for i, r in enumerate(raw) if len(r) < self.window]
        ids = {pieces[i]: self.long_piece(r) for i, r in enumerate(raw) if len(r) >= self.window}
        if short:
            ids.update(zip([pieces[i] for i in short], self.merge_many([raw[i] for i in short]), strict=True))
        return {w: b"".join([ids[p] for p in own]) for w, own in zip(new, parts, strict=True)}

    def with_special(self, text: str) -> bytes:
        """The packed ids of a text that holds strings of special tokens, which are cut out before anything else."""
        return b"".join(self.packed([self.special[p]]) if p in self.special else b"".join(self.learn([w])[w] for w in words_of(self.normal(p))) for p in self.cut.split(text) if p)

    def run(self, texts: list[list[str]]) -> list[bytes]:
        """The packed ids of texts given as words. Words seen lately are kept in two stores of bounded size, an older and a newer one."""
        new: set[str] = set()
        for words in texts:
            new.update(set(words).difference(self.words))
        if len(self.words) + len(new) > self.kept:
            self.older, self.words = self.words, {}
            new = {w for words in texts for w in words}
        again = [w for w in new if w in self.older]
        self.words.update((w, self.older[w]) for w in again)
        self.words.update(self.learn(list(new.difference(again))))
        out = [b"".join(map(self.words.__getitem__, words)) for words in texts]
        for w in [w for w in new if len(w) > 256]:  # long ones are not kept
            del self.words[w]
        return out

    def encode_all(self, texts: list[str | None], block: int = 1 << 20) -> list[bytes]:
        """The packed ids of each text. White space ends every piece, and no step of the normaliser crosses it; about ``block`` characters at a time are worked on."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush():
            for (i, _), got in zip(held, self.run([w for _, w in held]), strict=True):
                out[i].append(got)
            held.clear()

        for i, text in enumerate(texts):
            for part in blocks(text or "", block):
                if self.cut is not None and any(t in part for t in self.special):
                    flush()
                    out[i].append(self.with_special(part))
                    continue
                held.append((i, words_of(self.normal(part))))
                size += len(part)
                if size >= block:
                    flush()
                    size = 0
        flush()
        return [b"".join(x) for x in out]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def ids(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, np.uint16 if self.width == 2 else np.uint32)


def blocks(text: str, block: int) -> Iterator[str]:
    """The text in parts of about ``block`` characters, cut after white space."""
    at = 0
    while at < len(text):
        stop = at + block
        if stop < len(text):
            m = WHITE.search(text, stop)
            stop = m.end() if m else len(text)
        yield text[at:stop]
        at = stop


def words_of(text: str) -> list[str]:
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split takes them for white space, Unicode doesn't
        return [w for w in WHITE.split(text) if w]
    return text.split()


class Decoder:
    """Token ids to text: push() ids as they come; text comes out as soon as its bytes are complete."""

    def __init__(self, coder: Transducer, surface: bool = True):
        self.surface = surface
        n = max(coder.names) + 1
        if surface:
            self.table = [coder.names[i].encode() if i in coder.names else None for i in range(n)]
        else:
            back = {c: bytes([b]) for b, c in enumerate(coder.letters)}
            special = set(coder.special.values())
            self.table = [(coder.names[i].encode() if i in special else self.raw(coder.names[i], coder.end, back)) if i in coder.names else None for i in range(n)]
        self.whole = None not in self.table
        self.reset()

    @staticmethod
    def raw(token: str, end: str, back: dict[str, bytes]) -> bytes:
        word_end = bool(end) and token.endswith(end)
        token = token[: -len(end)] if word_end else token
        return b"".join(back[c] for c in token) + b" " * word_end

    def reset(self) -> None:
        self.machine, self.started = codecs.getincrementaldecoder("utf-8")("replace"), False

    def push(self, ids: list[int]) -> str:
        if not self.whole:
            ids = [i for i in ids if i < len(self.table) and self.table[i] is not None]
        if not ids:
            return ""
        if self.surface:
            out = (b" " if self.started else b"") + b" ".join(map(self.table.__getitem__, ids))
        else:
            out = b"".join(map(self.table.__getitem__, ids))
        self.started = True
        return self.machine.decode(out)

    def end(self) -> str:
        out = self.machine.decode(b"", True)
        self.reset()
        return out


def load(path: str) -> dict:
    """A tokenizer file as plain values (read on the driver, where the path is; it travels with the tasks)."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with ``ids`` (array<int>) and ``decoded`` (string). A vocabulary has a fixed size, whatever the data."""
    base = without(docs, *RESULT)
    names, sent = base.columns, docs.sparkSession.sparkContext.broadcast(load(path))
    text = next(c for c in names if c.lower() == "text")

    def run(batches):
        coder = Transducer(sent.value)
        back = Decoder(coder)
        for batch in slices(batches, text, 4 << 20):
            packed = [coder.ids(p) for p in coder.encode_all(batch.column(text).to_pylist())]
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, packed)]), pa.int32()), pa.array(np.concatenate(packed).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array([back.push(p.tolist()) + back.end() for p in packed], pa.string())], names=[*names, *RESULT])

    schema = ", ".join(f"{q} {t}" for q, (_, t) in zip(quoted(base), base.dtypes, strict=True))
    return base.mapInArrow(giving_back(run), f"{schema}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, chunk: int = 1 << 16) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, made chunk by chunk from the same encoder and decoder without keeping ids or text."""
    sent = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        coder = Transducer(sent.value)
        back = Decoder(coder)
        for batch in slices(batches, "text", 2 << 20):
            n, a, b = [], [], []
            for packed in coder.encode_all(batch.column("text").to_pylist(), 1 << 18):
                ids, of_ids, of_text = coder.ids(packed), hashlib.sha256(), hashlib.sha256()
                for i in range(0, len(ids), chunk):
                    part = ids[i : i + chunk]
                    of_ids.update(part.astype("<u4"))
                    of_text.update(back.push(part.tolist()).encode())
                of_text.update(back.end().encode())
                n.append(len(ids))
                a.append(of_ids.hexdigest())
                b.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(giving_back(run), f"doc_id {rows.dtypes[0][1]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
