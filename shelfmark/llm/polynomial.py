"""Characteristic polynomials of symmetric integer matrices, exactly, and their largest roots.

The polynomial is found modulo many primes, by reduction to Hessenberg form, and put together by
Chinese remaindering: with a product of primes above twice the largest possible coefficient,
it is exact. All roots of such a polynomial are real, so the number of roots above a point,
with multiplicity, is the number of sign changes of the polynomial shifted to that point. That
isolates each root between dyadic numbers, in integers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from math import isqrt

import numpy as np

#: Products of two residues must stay within 64 bits.
LARGEST_PRIME = 2**31


def _is_prime(n: int) -> bool:
    if n < 2 or n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    # These bases decide every number below 3 * 10**9.
    for base in (2, 3, 5, 7):
        if n == base:
            return True
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2**31, largest first, whose product is above ``bound``."""
    found, product, n = [], 1, LARGEST_PRIME - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def coefficient_bound(matrix: Sequence[Sequence[int]]) -> int:
    """No coefficient of the characteristic polynomial has a larger absolute value: that of
    x**(d-k) is a sum of C(d, k) products of k eigenvalues, none above the largest row sum."""
    d = len(matrix)
    largest = max((sum(abs(x) for x in row) for row in matrix), default=0)
    return (1 + largest) ** d * 2**d


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - M) modulo p, constant one first, by Hessenberg reduction."""
    h = matrix.astype(np.int64) % p
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m] % p) % p
        # The columns are changed so that the matrix stays similar to what it was.
        products = h[:, m + 1 :] * factors % p
        h[:, m] = (h[:, m] + products.sum(axis=1)) % p
    # The polynomials of the leading blocks, each from those before it.
    polynomials = np.zeros((d + 1, d + 1), np.int64)
    polynomials[0, 0] = 1
    for k in range(1, d + 1):
        now = np.zeros(d + 1, np.int64)
        now[1:] = polynomials[k - 1, :-1]
        now = (now - h[k - 1, k - 1] * polynomials[k - 1]) % p
        product = 1
        for i in range(k - 1, 0, -1):
            product = product * int(h[i, i - 1]) % p
            if product == 0:
                break
            now = (now - (int(h[i - 1, k - 1]) * product % p) * polynomials[i - 1]) % p
        polynomials[k] = now
    return polynomials[d].tolist()


def remaindered(residues: Sequence[tuple[int, Sequence[int]]]) -> list[int]:
    """The integers, positive or negative, that have these residues: (prime, one for each)."""
    product = 1
    for p, _ in residues:
        product *= p
    total = [0] * len(residues[0][1])
    for p, values in residues:
        rest = product // p
        weight = rest * pow(rest, -1, p)
        for i, value in enumerate(values):
            total[i] += value * weight
    half = product // 2
    return [(t + half) % product - half for t in total]


def _shifted(coefficients: Sequence[int], numerator: int, bits: int) -> list[int]:
    """Coefficients, up to positive factors, of the polynomial at x + numerator / 2**bits."""
    d = len(coefficients) - 1
    values = [c << (bits * (d - i)) for i, c in enumerate(coefficients)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            values[j] += numerator * values[j + 1]
    return values


def roots_above(coefficients: Sequence[int], numerator: int, bits: int = 0) -> int:
    """How many roots of a real-rooted polynomial lie above numerator / 2**bits."""
    signs = [c > 0 for c in _shifted(coefficients, numerator, bits) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign_at(coefficients: Sequence[int], numerator: int, bits: int) -> int:
    value = 0
    for i, c in enumerate(reversed(coefficients)):
        value = value * numerator + (c << (bits * i))
    return (value > 0) - (value < 0)


def largest_roots(coefficients: Sequence[int], wanted: int, bits: int = 160) -> Iterator[Fraction]:
    """The largest positive roots, falling, with multiplicity, each at most ``wanted`` of them.

    Each lies above the number given for it by less than its 2**-bits part. The polynomial has
    real roots only, none of them negative.
    """
    d = len(coefficients) - 1
    zeros = next((i for i, c in enumerate(coefficients) if c), d)
    coefficients = coefficients[zeros:]
    top = 1
    while roots_above(coefficients, top):
        top *= 2
    for number in range(1, min(wanted, d - zeros) + 1):
        # At least ``number`` roots lie above low / 2**places, fewer above high / 2**places.
        low, high, places = 0, top, 0
        alone = False
        while low == 0 or (high - low) << bits > low:
            if high - low == 1:
                low, high, places = 2 * low, 2 * high, places + 1
            middle = (low + high) // 2
            if not alone:
                count = roots_above(coefficients, low, places) - roots_above(coefficients, high, places)
                alone = count == 1
                sign = _sign_at(coefficients, high, places) if alone else 0
                alone = alone and sign != 0
            if alone:
                # One simple root in between: the sign alone tells on which side of it a point is.
                above = _sign_at(coefficients, middle, places)
                is_above = above not in (0, sign)
            else:
                is_above = roots_above(coefficients, middle, places) >= number
            low, high = (middle, high) if is_above else (low, middle)
        yield Fraction(low, 2**places)


def square_root(value: Fraction, bits: int = 200) -> Fraction:
    return Fraction(isqrt((value.numerator << (2 * bits)) // value.denominator), 2**bits)
