"""Comparison of replicas. Columns: replica_id, the id, and hash or unit fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.schema import ID, UNIT
from shelfmark.session import durable


#: Ids of a unit are compared in blocks of so many, then, where these differ, in leaves.
BLOCK, LEAF = 4096, 32


def digests(replicas: DataFrame, size: int, more: Sequence[str] = ()) -> DataFrame:
    """One row per replica and block of ``size`` ids of a unit: how many entries it has, and two sums
    of their hashes that do not depend on their order. Most are made before the shuffle, as
    entries are stored by id."""
    block = F.floor(F.col("entry_id") / F.lit(size)).alias("block")
    keys = [*ID, *more, "hash"]
    return replicas.groupBy("replica_id", *UNIT, block).agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64(*keys)).alias("folded"),
        F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(size), *keys), 32)).alias("total"),
    )


def differing(replicas: DataFrame, n: int, more: Sequence[str] = (), sizes: Sequence[int] = (BLOCK, LEAF)) -> DataFrame:
    """The rows of leaves that are not alike on all ``n`` replicas. Digests are compared level by
    level, finer ones of blocks only that differ; other rows are read, but not shuffled."""
    left = replicas
    for size in sizes:
        found = digests(left, size, more).groupBy(*UNIT, "block").agg(
            F.count(F.lit(1)).alias("held"),
            *(F.min(c).alias(f"least_{c}") for c in ("n", "folded", "total")),
            *(F.max(c).alias(f"most_{c}") for c in ("n", "folded", "total")),
        )
        alike = F.col("held") == n
        for c in ("n", "folded", "total"):
            alike = alike & (F.col(f"least_{c}") == F.col(f"most_{c}"))
        unlike = durable(found.filter(~alike).select(*UNIT, "block"))
        left = in_blocks(left, unlike, size)
    return left


def in_blocks(replicas: DataFrame, blocks: DataFrame, size: int, how: str = "left_semi") -> DataFrame:
    """The rows whose id lies in one of the blocks; with ``left_anti`` in none."""
    placed = replicas.withColumn("block", F.floor(F.col("entry_id") / F.lit(size)))
    return placed.join(blocks, [*UNIT, "block"], how).select(replicas.columns)


def common_hashes(replicas: DataFrame, n: int) -> DataFrame:
    """Entry hashes that are on all ``n`` replicas. A replica holds an id once.

    Leaves that are alike on all replicas are taken from one of them as they are; the others'
    rows are compared by a grouping.
    """
    more = ["leader_key"] if "leader_key" in replicas.columns else []
    keys = [*ID, *more, "hash"]
    unlike = durable(differing(replicas, n, more))
    held = unlike.groupBy(*keys).agg(F.count_distinct("replica_id").alias("replicas"))
    leaves = unlike.select(*UNIT, F.floor(F.col("entry_id") / F.lit(LEAF)).alias("block")).distinct()
    one = replicas.select(F.min("replica_id")).scalar()
    whole = in_blocks(replicas.filter(F.col("replica_id") == one), leaves, LEAF, "left_anti")
    return whole.select(*keys).unionByName(held.filter(F.col("replicas") == n).select(*keys))


def common_units(reports: DataFrame, n: int) -> DataFrame:
    """Closed units that all ``n`` replicas report in the same way."""
    closed = reports.filter(F.col("status") == "COMPLETED")
    held = closed.groupBy(*UNIT, "num_entries").agg(
        F.count_distinct("replica_id").alias("replicas")
    )
    return held.filter(F.col("replicas") == n).drop("replicas")


def ongoing_unit_agreed(reports: DataFrame, n: int) -> DataFrame:
    """Open units that all ``n`` replicas hold, with the smallest reported size."""
    opened = reports.groupBy(*UNIT).agg(
        F.min("num_entries").alias("num_entries"),
        F.count_distinct("replica_id").alias("replicas"),
        F.bool_or(F.col("status") == "ONGOING").alias("ongoing"),
    )
    return opened.filter((F.col("replicas") == n) & F.col("ongoing")).drop("replicas", "ongoing")


def missing_entries(replicas: DataFrame, source: int, target: int) -> DataFrame:
    """Ids that the source replica holds and the target lacks, looked for in leaves that differ."""
    two = replicas.filter(F.col("replica_id").isin(source, target))
    unlike = durable(differing(two, 2))
    held = unlike.filter(F.col("replica_id") == target).select(*ID)
    return unlike.filter(F.col("replica_id") == source).select(*ID).join(held, ID, "left_anti")


def hash_mismatch(replicas: DataFrame, a: int, b: int) -> DataFrame:
    """Ids that two replicas hold with different hashes, looked for in leaves that differ. A replica
    holds an id once."""
    unlike = durable(differing(replicas.filter(F.col("replica_id").isin(a, b)), 2))
    left = unlike.filter(F.col("replica_id") == a).select(*ID, F.col("hash").alias("hash_a"))
    right = unlike.filter(F.col("replica_id") == b).select(*ID, F.col("hash").alias("hash_b"))
    return left.join(right, ID).filter(F.col("hash_a") != F.col("hash_b"))


def union_results(*shards: DataFrame) -> DataFrame:
    result = shards[0]
    for other in shards[1:]:
        result = result.unionByName(other)
    return result


def buffer_minus_units(buffered: DataFrame, pulled: DataFrame) -> DataFrame:
    """Buffered units that did not also arrive by pull."""
    return buffered.join(pulled.select(*UNIT), UNIT, "left_anti")


def digest_audit(entries: DataFrame, digest, stored: str = "hash") -> DataFrame:
    """Rows whose stored digest differs from the recomputed one, or is missing."""
    return entries.withColumn("expected", digest).filter(
        ~F.col(stored).eqNullSafe(F.col("expected"))
    )
