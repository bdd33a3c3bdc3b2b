"""Telemetry window dumps and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfmark.schema import STATE_SCHEMA, TELEMETRY_WINDOW, WINDOWS_PER_DUMP

DUMP_SCHEMA = T.StructType(
    [T.StructField("window_start", T.TimestampType()), *STATE_SCHEMA.fields]
)


def _seconds(width: str) -> int:
    number, unit = width.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def with_dump_number(
    states: DataFrame, width: str = TELEMETRY_WINDOW, per_dump: int = WINDOWS_PER_DUMP
) -> DataFrame:
    """Add the window start and the number of the dump it belongs to.

    The number follows from the window itself (``per_dump`` consecutive windows
    share one), so it needs no counter and a retried batch gives the same files.
    """
    start = F.window("ts", width).getField("start")
    index = F.floor(F.unix_timestamp("window_start") / F.lit(_seconds(width) * per_dump))
    return states.withColumn("window_start", start).withColumn("dump", index)


def write_windows(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    width: str = TELEMETRY_WINDOW,
    per_dump: int = WINDOWS_PER_DUMP,
    keep: Column | None = None,
) -> StreamingQuery:
    """Append windows to numbered dump folders. Empty windows leave no trace.

    ``keep`` is an optional predicate over the packets (see ``window_filter``).
    """
    rows = with_dump_number(stream, width, per_dump)
    if keep is not None:
        rows = rows.filter(keep)
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("dump")
        .trigger(availableNow=True)
        .start()
    )


def replay_windows(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Read the dump files back as a stream, in the order they were written."""
    schema = T.StructType([*DUMP_SCHEMA.fields, T.StructField("dump", T.LongType())])
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def write_lag_json(lag: DataFrame, path: str) -> None:
    """Lag rows as JSON lines with the keys time, avgLag, maxLag, minLag."""
    lag.select(
        F.unix_millis("window_start").alias("time"),
        F.col("avg_lag").alias("avgLag"),
        F.col("max_lag").alias("maxLag"),
        F.col("min_lag").alias("minLag"),
    ).write.mode("overwrite").json(path)


def write_pct_json(lag: DataFrame, path: str) -> None:
    """Percentile rows as JSON lines with the keys time, fifty, seventyFive, ninety."""
    lag.select(
        F.unix_millis("window_start").alias("time"),
        "fifty",
        F.col("seventy_five").alias("seventyFive"),
        "ninety",
    ).write.mode("overwrite").json(path)


def write_shard_csv(overview: DataFrame, path: str, at_millis: int) -> None:
    """One line per shard. Shards without a leader get blanks after partition and depth."""
    known = F.col("leader_id").isNotNull()
    overview.select(
        "partition_id",
        "depth",
        F.when(known, F.lit(at_millis)).alias("time"),
        F.when(known, F.col("leader_entries")).alias("leader_entries"),
        F.when(known, F.col("nodes")).alias("nodes"),
        F.when(known, F.col("half")).alias("half"),
        F.when(known, F.col("three_quarters")).alias("three_quarters"),
        F.when(known, F.col("full")).alias("full"),
    ).write.mode("overwrite").csv(path)
