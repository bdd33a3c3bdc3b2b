"""Exact top-k search by tiled matrix products.

Queries are taken in blocks of bounded size. For each block every task multiplies the block
with tiles of its own rows, keeps the best of each tile by partial selection, and merges the
lists of its tiles; the lists of tasks are merged in a tree, a fan of them at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.work import work_dir

QUERY_BLOCK = 4096
TILE = 4096
FAN = 32
EXACT = float(2**53)
LIST_SCHEMA = "query_id long, vec_id long, score long, task int"


def quantised(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * 1024.0)


def usable(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and quantised vectors by vector length, without rows that take no part."""
    keep = ids.is_valid().to_numpy(False) & vectors.is_valid().to_numpy(False)
    ids, vectors = ids.filter(pa.array(keep)), vectors.filter(pa.array(keep))
    lengths = vectors.value_lengths().to_numpy(False) if len(vectors) else np.zeros(0, int)
    found = {}
    for size in np.unique(lengths):
        pick = pa.array(lengths == size)
        flat = vectors.filter(pick).flatten()
        whole = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(int((lengths == size).sum()), int(size))
        finite = np.isfinite(whole).all(axis=1)
        names = ids.filter(pick).to_numpy(False).astype(np.int64)[finite]
        if len(names):
            found[int(size)] = (names, quantised(whole[finite]))
    return found


def products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Integer inner products. Sums below 2**53 are exact in doubles; larger ones are taken
    with Python integers and held within the limits of a long."""
    if queries.size and tile.size:
        largest = np.abs(queries).max() * np.abs(tile).max() * queries.shape[1]
        if largest >= EXACT:
            whole = np.vectorize(int, otypes=[object])
            exact = whole(queries) @ whole(tile).T
            return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)
    return (queries @ tile.T).astype(np.int64)


def _best_rows(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each row of scores the k best (score descending, id ascending), own id left out."""
    found = []
    n = scores.shape[1]
    for row, name in zip(scores, own, strict=True):
        if n > 4 * k:
            # one more than k, as the query itself may be among them; ties at the edge all stay
            edge = np.partition(row, n - k - 1)[n - k - 1]
            at = np.flatnonzero(row >= edge)
        else:
            at = np.arange(n)
        at = at[ids[at] != name]
        at = at[np.lexsort((ids[at], -row[at]))[:k]]
        found.append((ids[at], row[at]))
    return found


def _distinct_ids(ids: np.ndarray, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Parts of a tile in which no id stands twice, so that no list is filled by one id."""
    parts = []
    while len(ids):
        _, first = np.unique(ids, return_index=True)
        if len(first) == len(ids):
            return [*parts, (ids, vectors)]
        parts.append((ids[first], vectors[first]))
        rest = np.ones(len(ids), dtype=bool)
        rest[first] = False
        ids, vectors = ids[rest], vectors[rest]
    return parts


def merged(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of several lists; an id counts once, with its best score."""
    ids = np.concatenate([p[0] for p in parts])
    scores = np.concatenate([p[1] for p in parts])
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], scores[first]


def tile_search(blocks, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map batches of (id, vector, task) to the best rows of the task for each query of a block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = blocks.value
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        task = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            task = batch.column(2)[0].as_py()
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                for size, (ids, vectors) in usable(part.column(0), part.column(1)).items():
                    if size not in block:
                        continue
                    own, queries = block[size]
                    for some_ids, some in _distinct_ids(ids, vectors):
                        lists = _best_rows(products(queries, some), some_ids, own, k)
                        for i, found in enumerate(lists):
                            held = best.get((size, i))
                            best[size, i] = merged([held, found], k) if held else found
        if best:
            rows = [(block[size][0][i], *best[size, i]) for size, i in best]
            sizes = [len(ids) for _, ids, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), sizes)),
                    pa.array(np.concatenate([r[1] for r in rows])),
                    pa.array(np.concatenate([r[2] for r in rows])),
                    pa.array(np.full(sum(sizes), task, np.int32)),
                ],
                names=["query_id", "vec_id", "score", "task"],
            )

    return search


def best_of(lists: DataFrame, k: int, tasks: int) -> DataFrame:
    """Merge lists of tasks as a tree: a fan of neighbouring tasks at each level."""
    order = (F.col("score").desc(), F.col("vec_id"))
    while True:
        tasks = -(-tasks // FAN)
        lists = (
            lists.withColumn("task", (F.col("task") / FAN).cast("int"))
            .groupBy("query_id", "task", "vec_id")
            .agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "task").orderBy(*order)))
            .filter(F.col("rank") <= k)
        )
        if tasks <= 1:
            return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k rows of the highest integer inner product with each query, without itself.

    Each component x counts as floor(1024 * x). Returns query_id, rank (from 1), vec_id, score;
    ties go to the smaller id. Rows with a null id or vector, or with null or non-finite
    components, take no part, nor do rows whose length differs from the query's. Ids that stand
    on several rows count once, with the best score; so do ids of queries. Empty tables give no
    rows. Other columns are ignored. Products beyond a long are held at its limits.

    Each block holds about ``query_block`` queries (by hash of the id): that many vectors, and
    no more, reach the driver and the tasks at once. Every block is one pass over the rows.
    """
    spark = rows.sparkSession
    asked = queries.select(F.col(id_column).alias("query_id"), F.col(vector_column).alias("v"))
    asked = asked.filter(F.col("query_id").isNotNull() & F.col("v").isNotNull())
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    table = rows.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(vector_column).alias("v"),
        F.spark_partition_id().alias("task"),
    )
    tasks = table.rdd.getNumPartitions()
    path = work_dir(spark, "topk") if blocks > 1 else None
    for number in range(blocks):
        part = asked.filter(F.col("block") == number).select("query_id", "v").toArrow()
        part = part.combine_chunks()
        held: dict[int, list] = {}
        for batch in part.to_batches():
            for size, found in usable(batch.column(0), batch.column(1)).items():
                held.setdefault(size, []).append(found)
        block = {
            size: (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
            for size, found in held.items()
        }
        lists = table.mapInArrow(tile_search(spark.sparkContext.broadcast(block), k), LIST_SCHEMA)
        best = best_of(lists, k, tasks)
        if path is None:
            return best
        best.write.mode("append").parquet(path)
    return spark.read.parquet(path)
