"""Edit distance of two word sequences within a band, by bit vectors."""

from __future__ import annotations

from collections.abc import Sequence


def banded_distance(a: Sequence[bytes], b: Sequence[bytes], limit: int) -> int:
    """Least number of inserted, deleted or replaced words that turn a into b, or ``limit + 1``
    if there are more than ``limit``.

    Column by column over the shorter sequence, the differences of vertical neighbours are held
    as bits of two integers, for the band of ``2 * limit + 1`` rows around the diagonal only: no
    path of at most ``limit`` edits leaves it. Cells outside count as one more than their
    neighbour inside. The distance is summed along the diagonal that ends in the last cell, which
    never falls, so the walk stops as soon as the sum exceeds ``limit``.
    """
    if len(a) < len(b):
        a, b = b, a
    low, top_a, top_b = 0, len(a), len(b)
    while low < top_b and a[low] == b[low]:
        low += 1
    while top_b > low and a[top_a - 1] == b[top_b - 1]:
        top_a -= 1
        top_b -= 1
    a, b = a[low:top_a], b[low:top_b]
    distance = len(a) - len(b)
    if distance > limit:
        return limit + 1
    if not b:
        return distance
    places: dict[bytes, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    width = 2 * limit + 1
    whole = (1 << width) - 1
    last = 1 << (width - 1)
    diagonal = 1 << (limit + distance)
    # bit t is row j - limit + t of column j; at column 0, rows from 1 on rise by one
    up = whole & ~((1 << (limit + 1)) - 1)
    down = 0
    get = places.get
    for j, word in enumerate(b, 1):
        up = up >> 1 | last
        down >>= 1
        shift = j - 1 - limit
        found = get(word, 0)
        match = (found >> shift if shift >= 0 else found << -shift) & whole
        level = ((((match & up) + up) ^ up) | match | down) & whole
        right_up = (down | ~(level | up)) & whole
        right_down = level & up
        if not level & diagonal:
            distance += 1
            if distance > limit:
                return limit + 1
        right_up = (right_up << 1 | 1) & whole
        right_down = right_down << 1 & whole
        up = (right_down | ~(level | right_up)) & whole
        down = level & right_up
    return distance


def near(a: Sequence[bytes], b: Sequence[bytes], similarity: float) -> bool:
    """Whether 1 - distance / (length of the longer) is at least ``similarity``."""
    longest = max(len(a), len(b))
    limit = int((1 - similarity) * longest + 1e-9)
    return banded_distance(a, b, limit) <= limit
