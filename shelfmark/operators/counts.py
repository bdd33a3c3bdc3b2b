"""Counts and extremes over entries, requests and nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.ordering import select_rank
from shelfmark.schema import SHARD, SPLIT_THRESHOLD, UNIT


def count_all(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def count_app_entries(df: DataFrame) -> DataFrame:
    """Rows that belong to an epoch."""
    return count_all(df.filter(F.col("epoch_id") >= 0))


def count_actual(df: DataFrame) -> DataFrame:
    """Rows whose entry id is not 0. The first entry of a unit is left out, as in the service."""
    return count_all(df.filter(F.col("entry_id") != 0))


def count_markers(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct(*UNIT).alias("n"))


def min_max_id(df: DataFrame, key: str = "id") -> DataFrame:
    """Smallest and largest id, 0 if there is none."""
    return df.agg(
        F.coalesce(F.min(key), F.lit(0)).cast("bigint").alias("min_id"),
        F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("max_id"),
    )


def last_marker(df: DataFrame) -> DataFrame:
    """The greatest (epoch, leader)."""
    return df.agg(F.max(F.struct(*UNIT)).alias("u")).select("u.*").filter("epoch_id IS NOT NULL")


def last_unit(units: DataFrame) -> DataFrame:
    """The greatest unit by epoch, leader, size."""
    top = units.agg(F.max(F.struct(*UNIT, "num_entries")).alias("u"))
    return top.select("u.*").filter("epoch_id IS NOT NULL")


def median_id(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The id at 0-based index n / 2 in id order, over entries of non-negative epochs."""
    rows = df.filter(F.col("epoch_id") >= 0)
    return select_rank(rows, groups, F.floor(F.col("total") / 2))


def unit_sizes(df: DataFrame) -> DataFrame:
    """Rows per unit."""
    return df.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("num_entries"))


def unit_expected_size(units: DataFrame, entries: DataFrame) -> DataFrame:
    """The known size of a unit, or the highest entry id + 1 if that is more."""
    seen = entries.groupBy(*UNIT).agg((F.max("entry_id") + 1).alias("seen"))
    return units.join(seen, UNIT, "left").select(
        *UNIT, F.greatest("num_entries", F.coalesce("seen", F.lit(0))).alias("num_entries")
    )


def latest_unit(reports: DataFrame, seq: str = "seq") -> DataFrame:
    """Upsert unit reports: the largest size wins, later on ties; the first pull status stays."""
    return reports.groupBy(*UNIT).agg(
        F.max_by(F.struct("num_entries", "status"), F.struct("num_entries", seq)).alias("u"),
        F.min_by("pull_status", seq).alias("pull_status"),
    ).select(*UNIT, "u.num_entries", "u.status", "pull_status")


def id_ranges(df: DataFrame, key: str = "id") -> DataFrame:
    """Per shard the smallest and largest id and their distance."""
    return df.groupBy(*SHARD).agg(
        F.min(key).alias("min_id"),
        F.max(key).alias("max_id"),
        F.abs(F.max(key) - F.min(key)).alias("id_span"),
    )


def duplicate_ids(df: DataFrame, key: str = "id", by: Sequence[str] = tuple(SHARD)) -> DataFrame:
    """Ids seen more than once in a shard."""
    seen = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("copies"))
    return seen.filter(F.col("copies") > 1)


def add_time_stats(times: DataFrame, last: int = 100) -> DataFrame:
    """Best and worst add time, and the whole-number mean of the last ``last`` ones.

    Columns: ts, add_id (tie-break), millis.
    """
    recent = times.orderBy(F.desc("ts"), F.desc("add_id")).limit(last)
    mean = recent.agg(
        F.floor(F.sum("millis") / F.count(F.lit(1))).cast("bigint").alias("mean_last")
    ).scalar()
    return times.agg(F.min("millis").alias("best"), F.max("millis").alias("worst")).withColumn(
        "mean_last", mean
    )


def entries_per_node_extremes(states: DataFrame) -> DataFrame:
    return states.agg(
        F.max("num_entries").alias("max_entries"), F.min("num_entries").alias("min_entries")
    )


def add_request_counts(requests: DataFrame, failed: Column, added: Column) -> DataFrame:
    """Totals of received, failed and added requests."""
    return requests.agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(failed).alias("failed"),
        F.count_if(added).alias("added"),
    )


def shard_due(df: DataFrame, threshold: int = SPLIT_THRESHOLD) -> DataFrame:
    """Shards with at least ``threshold`` entries, counted as ``count_actual`` does."""
    sizes = df.filter(F.col("entry_id") != 0).groupBy(*SHARD).agg(F.count(F.lit(1)).alias("n"))
    return sizes.filter(F.col("n") >= threshold)


def partition_counts(df: DataFrame) -> DataFrame:
    """Shards per category."""
    return df.groupBy("category").agg(F.count_distinct("shard_id").alias("shards"))
