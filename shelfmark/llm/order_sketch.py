"""Order MinHash sketches of texts: minimum occurrence-labelled word k-mers in text order."""

from __future__ import annotations

import numpy as np

from shelfmark.llm.words import U64, Words, mix, ngram_hashes, ngram_starts, occurrences

PLACE_BITS = 30


def order_sketches(words: Words, k: int, picked: int, sketches: int) -> np.ndarray:
    """One key per row and sketch: the ``picked`` least k-mers under that sketch's order,
    read in the order in which they stand in the text.

    A k-mer's label is the number of its earlier occurrences in the same text. A row of fewer
    than k words counts as one k-mer (none if it is empty).
    """
    starts = ngram_starts(words, k)
    kmers = ngram_hashes(words.hashes, k)[starts]
    rows = words.doc[starts]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = words.offsets()[short]
        whole = np.zeros(len(short), U64)
        for j in range(k):
            held = j < counts[short]
            at = np.where(held, first + j, 0)
            whole = np.where(held, mix(whole + words.hashes[at]), whole)
        order = np.argsort(np.concatenate([rows, short]), kind="stable")
        kmers = np.concatenate([kmers, whole])[order]
        rows = np.concatenate([rows, short])[order]
    labels = occurrences(mix(kmers ^ mix(rows.astype(U64) + U64(1))))
    elements = mix(kmers + labels.astype(U64) * U64(0xD1B54A32D192ED03))

    keys = np.zeros((words.rows, sketches), U64)
    sizes = np.bincount(rows, minlength=words.rows)
    held = np.flatnonzero(sizes)
    if not len(held):
        return keys
    first = (np.cumsum(sizes) - sizes)[held]
    sizes = sizes[held]
    of = np.repeat(np.arange(len(held)), sizes)
    place = (np.arange(len(rows)) - first[of]).astype(U64)
    low = U64(2**PLACE_BITS - 1)
    none = U64(2**64 - 1)
    rng = np.random.default_rng(20190801)
    draws = rng.integers(0, 2**63, size=(sketches, 2), dtype=np.uint64)
    for s in range(sketches):
        values = mix_light(elements, draws[s])
        values = (values & ~low) | (place & low)
        chosen = []
        for turn in range(picked):
            least = np.minimum.reduceat(values, first)
            chosen.append(least)
            if turn + 1 < picked:
                at = first + (least & low).astype(np.int64)
                values[np.where(least == none, first, at)] = none
        least = np.stack(chosen, axis=1)
        places = np.sort(np.where(least == none, low, least & low), axis=1)
        key = np.full(len(held), U64(s + 1), U64)
        for j in range(picked):
            real = places[:, j] != low
            at = first + np.where(real, places[:, j], 0).astype(np.int64)
            key = np.where(real, mix(key * U64(0x2545F4914F6CDD1D) + elements[at]), key)
        keys[held, s] = key
    return keys


def mix_light(x: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """A cheap order of well-mixed values: the high bits depend on all bits."""
    y = (x ^ draw[0]) * (draw[1] | U64(1))
    return y ^ (y >> U64(29))
