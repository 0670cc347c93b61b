"""Word shingles of many texts at once, as 64-bit numbers.

Words are runs of ASCII letters, digits and underscores, and of all characters beyond ASCII, in lower case. A text of fewer
words than a shingle has one shingle of all its words; a text without a word has none.
"""

from __future__ import annotations

import numpy as np

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
P = 0x9E3779B97F4A7C15
P_INVERSE = pow(P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the number of words of each text."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = WORD[buf]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(P, len(buf)), powers(P_INVERSE, len(buf))
    up *= buf
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(up, dtype=np.uint64)])
    hashes = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raw])
    upto = np.searchsorted(start, ends)
    return hashes, np.diff(upto, prepend=0)


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each text in order, repeats included, and their number."""
    own = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix(h + words[i : i + n] + np.uint64(i + 1))
    ok = own[:n] == own[k - 1 : k - 1 + n] if n else np.zeros(0, bool)
    h, whose = h[ok], own[:n][ok]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.cumsum(counts) - counts
        more = []
        for d in short:
            x = np.zeros(1, np.uint64)
            for i in range(counts[d]):
                x = mix(x + words[first[d] + i] + np.uint64(i + 1))
            more.append(mix(x + np.uint64(counts[d] + 1000))[0])
        h, whose = np.concatenate([h, np.array(more, np.uint64)]), np.concatenate([whose, short])
        order = np.argsort(whose, kind="stable")
        h, whose = h[order], whose[order]
    return h, np.bincount(whose, minlength=len(counts))
