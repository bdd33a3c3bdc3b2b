"""Words of Arrow text columns as numpy arrays: places, hashes, hashes of word n-grams.

Words are the runs of bytes other than space and \\x09-\\x0d. Texts are taken in slices of a
few megabytes, so a task holds the arrays of one slice only; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
SLICE_BYTES = 2 * 2**20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES)
        tables = []
        for factor in (BASE, pow(BASE, -1, 2**64)):
            table = np.full(size, factor, U64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers = (tables[0], tables[1])
    return _powers


@dataclass
class Words:
    """The words of a slice of rows. ``doc`` is the row of each word, within the slice."""

    first_row: int
    rows: int
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    data: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.rows)

    def offsets(self) -> np.ndarray:
        """Where the words of each row begin; one entry more than rows."""
        return np.concatenate([[0], np.cumsum(self.counts())])


def text_slices(texts: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, row offsets and bytes of slices of a text column; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + slice_bytes, side="right")) - 1
        last = min(n, max(last, row + 1))
        begin, end = int(offsets[row]), int(offsets[last])
        yield row, offsets[row : last + 1] - begin, data[begin:end]
        row = last


def word_slices(texts: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    for row, offsets, data in text_slices(texts, slice_bytes):
        n = len(data)
        solid = np.zeros(n + 2, dtype=bool)
        np.logical_not(_BLANK[data], out=solid[1:-1])
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
        end = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
        power, inverse = _power_tables(n)
        total = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * power[:n], out=total[1:])
        hashes = mix((total[end] - total[start]) * inverse[start])
        doc = np.searchsorted(offsets, start, side="right") - 1
        yield Words(row, len(offsets) - 1, doc, start, end, hashes, data)


def ngram_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive words, over the ends of rows too: see ``ngram_starts``."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    factor = U64(BASE + 2 * seed)
    count = len(hashes) - n + 1
    total = hashes[:count].copy()
    for j in range(1, n):
        total *= factor
        total += hashes[j : j + count]
    return mix(total)


def ngram_starts(words: Words, n: int) -> np.ndarray:
    """The word numbers at which n words of the same row begin."""
    count = len(words.doc) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.doc[:count] == words.doc[n - 1 :])


def occurrences(keys: np.ndarray) -> np.ndarray:
    """How often the same key has stood before, for each key."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return np.zeros(len(keys), np.int64)
    places = np.arange(len(keys))
    begun = np.maximum.accumulate(np.where(fresh, places, 0))
    found = np.empty(len(keys), np.int64)
    found[order] = places - begun
    return found
