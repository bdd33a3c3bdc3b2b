"""Characteristic polynomials, root isolation, and whitening against numpy and plain sums."""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

import numpy as np
import pytest

from shelfmark.llm.polynomial import (
    coefficient_bound,
    largest_roots,
    polynomial_modulo,
    primes_beyond,
    remaindered,
    roots_above,
)
from shelfmark.llm.whitening import null_vectors, whiten

SCHEMA = "vec_id long, embedding array<float>, component string, n string, size string"


def plain_polynomial(matrix):
    """det(x - M) as the sum of principal minors."""

    def det(m):
        if not m:
            return 1
        return sum((-1) ** j * m[0][j] * det([r[:j] + r[j + 1 :] for r in m[1:]]) for j in range(len(m)))

    d = len(matrix)
    found = [0] * (d + 1)
    for k in range(d + 1):
        minors = (det([[matrix[i][j] for j in at] for i in at]) for at in itertools.combinations(range(d), k))
        found[d - k] = (-1) ** k * sum(minors)
    return found


def exact_polynomial(matrix):
    whole = np.array(matrix, object)
    primes = primes_beyond(2 * coefficient_bound(matrix))
    return remaindered([(p, polynomial_modulo(whole % p, p)) for p in primes])


@pytest.mark.parametrize("seed", range(6))
def test_polynomial(seed):
    rng = np.random.default_rng(seed)
    d = 1 + seed
    m = rng.integers(-(10**9), 10**9, (d, d))
    if seed % 2:
        m[rng.random((d, d)) < 0.5] = 0  # pivots that must be looked for
    matrix = (m + m.T).tolist()
    assert exact_polynomial(matrix) == plain_polynomial(matrix)


def test_roots():
    # (x-2)^2 (x-7) (x-3/2)... with a root of zero, all real
    coefficients = [1]
    for numerator, denominator in ((2, 1), (2, 1), (7, 1), (3, 2), (0, 1)):
        longer = [0] * (len(coefficients) + 1)
        for i, c in enumerate(coefficients):
            longer[i + 1] += denominator * c
            longer[i] -= numerator * c
        coefficients = longer
    assert [roots_above(coefficients, a) for a in (-1, 0, 1, 2, 6, 7)] == [5, 4, 4, 1, 1, 0]
    roots = list(largest_roots(coefficients, 9))
    assert len(roots) == 4
    for root, wanted in zip(roots, (7, 2, 2, 1.5), strict=True):
        assert abs(root - Fraction(wanted)) < Fraction(1, 2**100)


def test_null_vectors_of_repeated_roots():
    matrix = np.array([[3, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 0], [0, 0, 0, 1]], object)
    turn = np.array([[1, 1, 0, 0], [1, -1, 0, 0], [0, 0, 1, 1], [0, 0, 1, -1]], object)
    whole = turn @ matrix @ turn.T
    roots = list(largest_roots(exact_polynomial(whole.tolist()), 4))
    assert [float(r) for r in roots] == [10, 10, 6, 2]
    vectors = np.array([[float(x) for x in v] for v in null_vectors(whole, roots)])
    assert np.abs(vectors @ vectors.T - np.eye(4)).max() < 1e-15
    scaled = vectors @ whole.astype(float) @ vectors.T
    assert np.abs(scaled - np.diag([10, 10, 6, 2])).max() < 1e-13


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, components=8):
    used = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(used), len(used[0][1])
    sums = [sum(x[k] for _, x in used) for k in range(d)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for _, x in used]
    far = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for _, x in used])
    values, vectors = np.linalg.eigh(far.T @ far / n)
    order = np.argsort(-values)[:components]
    return used, n, deviations, values[order], far @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def vectors(count, size, seed):
    rng = np.random.default_rng(seed)
    spread = 1.0 / (1 + np.arange(size))
    return [(i, [float(np.float32(x)) for x in rng.normal(size=size) * spread]) for i in range(count)]


@pytest.mark.parametrize("size", [3, 12])
def test_whitening(spark, size):
    good = vectors(400, size, size)
    good += [(7, good[3][1]), (None, good[5][1])]  # a repeated id, a null id
    bad = [(1001, None), (1002, []), (1003, [math.nan] * size), (1004, [math.inf] + [1.0] * (size - 1)), (1005, [None] + [1.0] * (size - 1))]
    got = whiten(table(spark, good + bad)).collect()
    used, n, deviations, values, white, explained = plain(good)
    count = min(8, size)
    assert len(got) == len(good) * count
    names = sorted(((i if i is not None else -1), d) for (i, _), d in zip(used, deviations, strict=True))
    for k in range(1, count + 1):
        part = [r for r in got if r.component == k]
        assert sorted((r.vec_id if r.vec_id is not None else -1, r.deviation) for r in part) == names
        assert {r.n for r in part} == {n}
        assert all(abs(r.explained / explained[k - 1] - 1) < 1e-9 for r in part)
        wanted = {d: w for d, w in zip(deviations, white[:, k - 1], strict=True)}
        sign = 1 if max(abs(r.whitened - wanted[r.deviation]) for r in part) < 1e-6 else -1
        assert all(abs(sign * r.whitened - wanted[r.deviation]) < 1e-9 for r in part)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_tables_without_variance(spark):
    assert whiten(table(spark, [])).collect() == []
    assert whiten(table(spark, [(1, [1.0, 2.0])] * 5)).collect() == []
    assert whiten(table(spark, [(1, None), (2, [math.nan])])).collect() == []


def test_fewer_components_than_dimensions(spark):
    """Three points in five dimensions span two components."""
    rows = [(1, [1.0, 0.0, 0.0, 0.5, 2.0]), (2, [0.0, 1.0, 0.0, 0.5, 2.0]), (3, [0.0, 0.0, 3.0, 0.5, 2.0])]
    got = whiten(table(spark, rows)).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(i, k) for i in (1, 2, 3) for k in (1, 2)]
    assert got[0].identity_error < 1e-12
    assert abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12


def test_lengths_and_large_entries(spark):
    rows = vectors(40, 2, 1) + [(100 + i, v) for i, v in vectors(30, 3, 2)]
    rows += [(200, [1e30, -1e30]), (201, [1e30, 3e37])]
    got = whiten(table(spark, rows)).collect()
    assert {r.n for r in got} == {42, 30}
    assert all(r.identity_error < 1e-6 and math.isfinite(r.whitened) for r in got)
    assert max(r.deviation for r in got) == 2**63 - 1
