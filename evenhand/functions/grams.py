"""Counts of words and word pairs as 64-bit hashes in arrays: what a passage's length in the n-gram space needs of terms that nobody asks for.

Terms themselves are never made: a word is its hash (of 64 bits; two of a hundred million terms share one with a chance of 1 in 3,700), a pair is mixed from two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1_000_000  # words of the passages that are sorted at once


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs from those of their words, in order."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (b.view(np.uint64) ^ (b.view(np.uint64) >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all rows after one another, their number in each row) of a column of lists; a missing list is an empty one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def grams(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram): words and pairs of words that follow each other in a row."""
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    near = row[1:] == row[:-1]
    return np.concatenate([row, row[1:][near]]), np.concatenate([words, paired(words[:-1][near], words[1:][near])])


def distinct(row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, how often), by row and gram."""
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    at = np.flatnonzero(first)
    return row[at], gram[at], np.diff(np.append(at, len(row)))


def counts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``distinct`` of the grams of all rows of a column of word lists, some rows at a time."""
    words, lengths = flat(column)
    ends, found, start = np.cumsum(lengths), [], 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
        row, gram, tf = distinct(*grams(words[before : ends[stop - 1]], lengths[start:stop]))
        found.append((row + np.int32(start), gram, tf))
        start = stop
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))


def places(sorted_keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each asked key among the sorted ones, whether it is there)."""
    at = np.minimum(np.searchsorted(sorted_keys, asked), max(len(sorted_keys) - 1, 0))
    return at, (sorted_keys[at] == asked if len(sorted_keys) else np.zeros(len(asked), dtype=bool))
