"""Helpers that the operators share: tables in the shared folder, and filters of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import durable, work_dir

__all__ = [
    "FILTER_BITS",
    "batches_of_bytes",
    "durable",
    "free_name",
    "held",
    "key_filter",
    "only_rows",
    "rows_in_filter",
    "small_batches",
    "without_rows",
    "work_dir",
]

#: A filter is 8 MB, whatever the number of its keys. With more keys it lets more rows through
#: that are not meant; it never keeps back one that is.
FILTER_BITS = 26
#: Each key sets so many bits, whose places are parts of the key.
PARTS = 4


def _shifts(bits: int) -> list[int]:
    return [(64 - bits) * i // (PARTS - 1) for i in range(PARTS)]


def key_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> Broadcast:
    """A set of long keys as 2**bits bits.

    Keys must be spread over all values of a long, as hashes are. At most 2**(bits - 6) rows
    reach the driver, whatever the number of keys.
    """
    parts = [F.shiftrightunsigned(F.col(column), s).bitwiseAND(2**bits - 1) for s in _shifts(bits)]
    words = (
        keys.select(F.explode(F.array(*parts)).alias("place"))
        .select(
            F.shiftright("place", 6).cast("int").alias("word"),
            F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    table = np.zeros(2 ** (bits - 6), np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def held(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (unsigned) may be in the set."""
    bits = int(table.size).bit_length() - 1 + 6
    found = np.ones(len(keys), dtype=bool)
    for shift in _shifts(bits):
        # later parts are looked up for the keys that are still in question
        at = np.flatnonzero(found)
        place = (keys[at] >> np.uint64(shift)) & np.uint64(2**bits - 1)
        found[at] = (table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _by_filter(found: Broadcast, wanted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.num_columns - 1).to_numpy(False).view(np.uint64)
            keep = held(found.value, keys) == wanted
            rest = batch.select(list(range(batch.num_columns - 1)))
            yield rest if keep.all() else rest.filter(pa.array(keep))

    return sift


def rows_in_filter(df: DataFrame, column: str, found: Broadcast, wanted: bool = True) -> DataFrame:
    """The rows whose ``column`` may be (or, with ``wanted=False``, surely is not) in a set
    of xxhash64 values. Done before a join, it keeps most other rows out of the shuffle."""
    hashed = df.withColumn(free_name(df, "key_of_row"), F.xxhash64(column))
    return hashed.mapInArrow(_by_filter(found, wanted), df.schema)


def _filter_of(ids: DataFrame, column: str) -> Broadcast:
    return key_filter(ids.select(F.xxhash64(column).alias("hash")), "hash")


def without_rows(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of df whose ``column`` is none of ``ids``. Only rows that a filter of the ids lets
    through are shuffled for the exact test; the others stay where they are."""
    found = _filter_of(ids, column)
    tested = rows_in_filter(df, column, found).join(ids, column, "left_anti").select(df.columns)
    return rows_in_filter(df, column, found, wanted=False).unionByName(tested)


def only_rows(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of df whose ``column`` is one of ``ids``; see ``without_rows``."""
    found = rows_in_filter(df, column, _filter_of(ids, column))
    return found.join(ids, column, "left_semi").select(df.columns)


def small_batches(spark: SparkSession) -> None:
    """Fewer rows at a time between Spark and Python than is usual: these rows hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


@contextmanager
def batches_of_bytes(spark: SparkSession, size: int = 16 * 2**20, rows: int = 10_000) -> Iterator[None]:
    """Batches between Spark and Python of at most so many bytes and rows (one row at least), for
    what is written inside; the session's own settings come back after it."""
    wanted = {
        "spark.sql.execution.arrow.maxBytesPerBatch": str(size),
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
