"""A bidirectional FM-index over word numbers, for phrases of limited length.

The rows of the index are the suffixes of a sequence in the order of their first words, and the
Burrows-Wheeler transform names the word before each suffix. All suffixes that begin with a phrase
are one interval of rows, whose size is the number of its occurrences; the rows whose transform
is c map onto the interval of the phrase with c before it. A second index, of the reversed
sequence, is kept in step and grows phrases at their other end. Intervals of all phrases of one
length are extended at once, by all words that stand beside them.

Suffixes are ordered by their first words only, twice as many at each round, up to the length that
phrases may have: within such an order every phrase still is one interval.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Rows:
    """Suffixes of a sequence ordered by their first ``depth`` words; the sequence ends with 0."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank = text.astype(np.int64)
        order = np.argsort(rank, kind="stable")
        known = 1
        while known < depth:
            later = np.zeros(n, np.int64)
            later[: max(n - known, 0)] = rank[known:]
            key = rank * (int(rank.max(initial=0)) + 1) + later
            order = np.argsort(key)
            ranked = key[order]
            fresh = np.ones(n, np.int64)
            fresh[1:] = ranked[1:] != ranked[:-1]
            rank[order] = np.cumsum(fresh)
            known *= 2
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.suffix = order
        self.first = text[order]
        # The row of each suffix without its first word: the transform's mapping, read backwards.
        self.after = place[(order + 1) % n]


@dataclass
class Intervals:
    """Phrases of one length: their rows in either index, and how often they occur."""

    length: int
    low: np.ndarray
    low_reversed: np.ndarray
    size: np.ndarray
    parent: np.ndarray

    def only(self, keep: np.ndarray) -> Intervals:
        return Intervals(self.length, self.low[keep], self.low_reversed[keep], self.size[keep], self.parent[keep])


class BidirectionalIndex:
    """Over word numbers from 1; 0 ends a piece, stands at both ends, and is in no phrase."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text = text
        self.depth = depth
        self.forward = _Rows(text, depth)
        self.reversed = _Rows(text[::-1], depth)

    def words(self) -> Intervals:
        """All single words. Both indexes hold the same words, so the intervals are the same."""
        at = np.flatnonzero(self.forward.first > 0)
        low, size = _runs(at, self.forward.first[at])
        return Intervals(1, low, low.copy(), size, np.full(len(low), -1))

    def extend_left(self, phrases: Intervals) -> Intervals:
        """All phrases with one word more in front; ``parent`` numbers the phrase they extend."""
        low, other, size, parent = _extended(self.forward, phrases.low, phrases.low_reversed, phrases.size)
        return self._checked(Intervals(phrases.length + 1, low, other, size, parent))

    def extend_right(self, phrases: Intervals) -> Intervals:
        """All phrases with one word more behind; ``parent`` numbers the phrase they extend."""
        low, other, size, parent = _extended(self.reversed, phrases.low_reversed, phrases.low, phrases.size)
        return self._checked(Intervals(phrases.length + 1, other, low, size, parent))

    def _checked(self, phrases: Intervals) -> Intervals:
        if phrases.length > self.depth:
            raise ValueError(f"the index orders suffixes by {self.depth} words only")
        return phrases

    def places(self, phrases: Intervals) -> np.ndarray:
        """Where one occurrence of each phrase begins."""
        return self.forward.suffix[phrases.low]


def _runs(at: np.ndarray, *names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and size of the runs of rows with equal names."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.zeros(len(at), dtype=bool)
    fresh[0] = True
    for name in names:
        fresh[1:] |= name[1:] != name[:-1]
    start = np.flatnonzero(fresh)
    return at[start], np.diff(np.append(start, len(at)))


def _extended(rows: _Rows, low: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals one word longer at the front of the indexed sequence, and where they lie in the
    other index: behind the phrases that end there, and those extended by smaller words."""
    owner = np.full(len(rows.first), -1, np.int64)
    count = int(size.sum())
    begun = np.repeat(low - (np.cumsum(size) - size), size)
    owner[begun + np.arange(count)] = np.repeat(np.arange(len(low)), size)
    of = owner[rows.after]
    at = np.flatnonzero((rows.first > 0) & (of >= 0))
    word, of = rows.first[at], of[at]
    new_low, new_size = _runs(at, word, of)
    start = np.cumsum(new_size) - new_size
    word, parent = word[start], of[start]
    ended = size - np.bincount(of, minlength=len(low))
    order = np.lexsort((word, parent))
    before = np.cumsum(new_size[order]) - new_size[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = parent[order][1:] != parent[order][:-1]
    within = before - np.maximum.accumulate(np.where(fresh, before, 0))
    new_other = np.empty(len(order), np.int64)
    new_other[order] = (other + ended)[parent[order]] + within
    return new_low, new_other, new_size, parent
