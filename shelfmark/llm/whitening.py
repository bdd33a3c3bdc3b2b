"""Whitening of vectors along the eigenvectors of their covariance, found in exact arithmetic.

Entries become integers, so the scatter matrix (n times the sum of products, less the products
of the sums) is a matrix of integers, summed over all rows without rounding. Its characteristic
polynomial is exact as well, its largest roots are isolated to 160 bits, and each component is
what inverse iteration with 100 digits finds in the null space of the matrix less the root.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.polynomial import (
    coefficient_bound,
    largest_roots,
    polynomial_modulo,
    primes_beyond,
    remaindered,
)
from shelfmark.llm.work import batches_of_bytes, durable

COMPONENTS = 8
SCALE = 1024.0
#: Added to each entry by contract. It moves no covariance, so sums are taken without it.
SHIFT = 100_000
DIGITS = 100
ROUNDS = 3
LONG = 2**63 - 1
LIMB = 32
LIMBS = 6
CHUNK = 4096

SUM_SCHEMA = "size int, i int, j int, " + ", ".join(f"limb{k} long" for k in range(LIMBS))
RESIDUE_SCHEMA = "size int, prime long, residues array<long>"
ROW_SCHEMA = "vec_id long, size int, deviation long, whitened array<double>"


@dataclass(frozen=True)
class Fit:
    """Whitening of vectors of one length: sums without the shift, unit columns, eigenvalues of
    the covariance."""

    rows: int
    sums: list[int]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def _usable(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer entries (as doubles) of the rows that take part, by vector length."""
    keep = vectors.is_valid().to_numpy(False)
    ids, vectors = ids.filter(pa.array(keep)), vectors.filter(pa.array(keep))
    lengths = vectors.value_lengths().to_numpy(False) if len(vectors) else np.zeros(0, int)
    for size in np.unique(lengths[lengths > 0]):
        pick = pa.array(lengths == size)
        flat = vectors.filter(pick).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        whole = flat.reshape(-1, int(size))
        finite = np.isfinite(whole).all(axis=1)
        if finite.any():
            entries = np.clip(np.floor(whole[finite] * SCALE), -float(2**62), float(2**62))
            yield ids.filter(pick).filter(pa.array(finite)), entries


def _whole(values: np.ndarray) -> np.ndarray:
    return np.vectorize(int, otypes=[object])(values) if values.size else values.astype(object)


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (i = j = -1), sums (j = -1) and sums of products of a task, in limbs of 32 bits."""
    totals: dict[int, list] = {}
    for batch in batches:
        for _, entries in _usable(batch.column(0), batch.column(1)):
            size = entries.shape[1]
            held = totals.setdefault(size, [0, np.zeros(size, object), np.zeros((size, size), object)])
            for at in range(0, len(entries), CHUNK):
                part = entries[at : at + CHUNK]
                if np.abs(part).max() ** 2 * len(part) >= 2.0**53:
                    part = _whole(part)  # sums in doubles would round
                held[0] += len(part)
                held[1] = held[1] + _whole(part.sum(axis=0))
                held[2] = held[2] + _whole(part.T @ part)
    for size, (count, sums, products) in totals.items():
        rows = [(-1, -1, count), *((i, -1, int(s)) for i, s in enumerate(sums))]
        rows += [(i, j, int(products[i, j])) for i in range(size) for j in range(i, size)]
        limbs = [[(1 if v >= 0 else -1) * (abs(v) >> (LIMB * k) & (2**LIMB - 1)) for _, _, v in rows] for k in range(LIMBS)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([size] * len(rows), pa.int32()),
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.int32()),
                *(pa.array(limb, pa.int64()) for limb in limbs),
            ],
            names=["size", "i", "j", *(f"limb{k}" for k in range(LIMBS))],
        )


def _residues(matrices: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for size, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.append(polynomial_modulo(matrices.value[size] % p, p))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))],
                names=["size", "prime", "residues"],
            )

    return reduce


def characteristic_polynomials(spark: SparkSession, matrices: dict[int, np.ndarray]) -> dict[int, list[int]]:
    """Exact coefficients, constant one first, of symmetric integer matrices keyed by their size.
    Primes are dealt to the tasks."""
    asked = [(size, p) for size, m in matrices.items() for p in primes_beyond(2 * coefficient_bound(m.tolist()))]
    if not asked:
        return {}
    primes = spark.createDataFrame(asked, "size int, prime long")
    primes = primes.repartition(min(len(asked), spark.sparkContext.defaultParallelism), "prime")
    found = primes.mapInArrow(_residues(spark.sparkContext.broadcast(matrices)), RESIDUE_SCHEMA).collect()
    by_size: dict[int, list] = {}
    for row in found:
        by_size.setdefault(row.size, []).append((row.prime, row.residues))
    return {size: remaindered(residues) for size, residues in by_size.items()}


def _decimal(value: Fraction, context: Context) -> Decimal:
    return context.divide(Decimal(value.numerator), Decimal(value.denominator))


def _unit(vector: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for other in others:
        vector = vector - other * (other * vector).sum()
    return vector / (vector * vector).sum().sqrt()


def null_vectors(matrix: np.ndarray, roots: list[Fraction]) -> list[np.ndarray]:
    """A unit vector in the null space of matrix - root for each root; of equal roots, and of
    all others, they are orthogonal."""
    d = len(matrix)
    found: list[np.ndarray] = []
    with localcontext(prec=DIGITS) as context:
        rng = np.random.default_rng(d)
        for root in roots:
            work = np.vectorize(Decimal, otypes=[object])(matrix)
            work[np.arange(d), np.arange(d)] -= _decimal(root, context)
            least = _decimal(root, context) * Decimal(10) ** -60
            order = np.arange(d)
            for m in range(d):
                pivot = m + int(np.argmax(np.abs(work[m:, m])))
                work[[m, pivot]], order[[m, pivot]] = work[[pivot, m]], order[[pivot, m]]
                if abs(work[m, m]) < least:
                    work[m, m] = least
                if m + 1 < d:
                    work[m + 1 :, m] = work[m + 1 :, m] / work[m, m]
                    work[m + 1 :, m + 1 :] -= np.multiply.outer(work[m + 1 :, m], work[m, m + 1 :])
            start = np.array([Decimal(int(x)) for x in rng.integers(-1000, 1000, d) * 2 + 1], object)
            vector = _unit(start, found)
            for _ in range(ROUNDS):
                vector = vector[order]
                for m in range(1, d):
                    vector[m] -= (work[m, :m] * vector[:m]).sum()
                for m in range(d - 1, -1, -1):
                    rest = (work[m, m + 1 :] * vector[m + 1 :]).sum() if m + 1 < d else 0
                    vector[m] = (vector[m] - rest) / work[m, m]
                vector = _unit(vector, found)
            found.append(vector)
    return found


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The whitening of each vector length in a table (vec_id, v): only sums reach the driver, a
    number of them that depends on the lengths alone."""
    spark = vectors.sparkSession
    limbs = [F.sum(f"limb{k}").alias(f"limb{k}") for k in range(LIMBS)]
    sums = vectors.mapInArrow(_scatter, SUM_SCHEMA).groupBy("size", "i", "j").agg(*limbs).collect()
    held: dict[int, dict[tuple[int, int], int]] = {}
    for row in sums:
        held.setdefault(row["size"], {})[row["i"], row["j"]] = sum(row[f"limb{k}"] << (LIMB * k) for k in range(LIMBS))
    matrices = {}
    for size, parts in held.items():
        n = parts[-1, -1]
        matrix = np.zeros((size, size), object)
        for i in range(size):
            for j in range(i, size):
                matrix[i, j] = matrix[j, i] = n * parts[i, j] - parts[i, -1] * parts[j, -1]
        matrices[size] = matrix
    polynomials = characteristic_polynomials(spark, matrices)
    fits = {}
    for size, matrix in matrices.items():
        n = held[size][-1, -1]
        roots = list(largest_roots(polynomials[size], components))
        columns = null_vectors(matrix, roots)
        trace = sum(matrix[i, i] for i in range(size))
        fits[size] = Fit(
            n,
            [held[size][i, -1] for i in range(size)],
            np.array([[float(x) for x in c] for c in columns]).reshape(len(columns), size).T,
            np.array([float(r / n**2) for r in roots]),
            np.array([float(r / trace) for r in roots]),
        )
    return fits


def _project(fits: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, entries in _usable(batch.column(0), batch.column(1)):
                size = entries.shape[1]
                found = fits.value[size]
                n, sums = found.rows, found.sums
                most = n * float(np.abs(entries).max()) + float(max(abs(s) for s in sums))
                kind = np.int64 if most**2 * size < 2.0**62 else object
                far = (entries.astype(np.int64) if kind is np.int64 else _whole(entries)) * n - np.array(sums, kind)
                far = (far * far).sum(axis=1)
                deviation = [min(int(x), LONG) for x in far]
                mean = np.array([float(Fraction(s, n)) for s in sums])
                whitened = (entries - mean) @ found.vectors / np.sqrt(found.eigenvalues)
                count = whitened.shape[1]
                edges = np.arange(len(entries) + 1, dtype=np.int32) * count
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.cast(pa.int64()),
                        pa.array([size] * len(entries), pa.int32()),
                        pa.array(deviation, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(edges), pa.array(whitened.reshape(-1))),
                    ],
                    names=["vec_id", "size", "deviation", "whitened"],
                )

    return project


def identity_error(rows: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity."""
    if components == 0:
        return 0.0
    parts = [F.col("whitened")[i] for i in range(components)]
    means = rows.agg(*(F.avg(p) for p in parts)).first()
    centred = [p - F.lit(m) for p, m in zip(parts, means, strict=True)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    measured = rows.agg(*(F.avg(centred[i] * centred[j]) for i, j in pairs)).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, measured, strict=True))


def whiten(
    rows: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1, by falling eigenvalue), n,
    deviation, whitened, explained, identity_error.

    An entry c counts as x = floor(1024 * c) + 100000, held within 2**62 of the shift. The fit list
    is all rows whose vector is neither null nor holds null or non-finite entries; other rows,
    and empty vectors, give no rows. ``n`` is the length of the fit list, ``deviation`` the
    sum over the dimensions of (n*x - S)**2 with S the sum of x (at most the largest long),
    ``whitened`` the centred vector along the component over the square root of its eigenvalue,
    ``explained`` the eigenvalue's share of all variance, ``identity_error`` the largest absolute
    entry of the covariance of ``whitened`` minus the identity, measured over all rows.

    Components without any variance are left out: a table of equal vectors, or of one, has none,
    and gives no rows, nor does an empty table. Repeated rows count as often as they stand, null
    ids stay. Vectors of another length are whitened among themselves. Other columns are ignored.
    """
    vectors = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"))
    fits = fit(vectors, components)
    spark = rows.sparkSession
    projected = vectors.mapInArrow(_project(spark.sparkContext.broadcast(fits)), ROW_SCHEMA)
    with batches_of_bytes(spark):
        projected = durable(projected)
    tables = []
    for size, found in sorted(fits.items()):
        count = len(found.eigenvalues)
        if not count:
            continue
        part = projected.filter(F.col("size") == size)
        error = identity_error(part, count)
        shares = F.array(*(F.lit(float(e)) for e in found.explained))
        tables.append(
            part.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
                "vec_id",
                (F.col("at") + 1).alias("component"),
                F.lit(found.rows).cast("long").alias("n"),
                "deviation",
                "whitened",
                shares[F.col("at")].alias("explained"),
                F.lit(error).alias("identity_error"),
            )
        )
    if not tables:
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], schema)
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result
