"""Telemetry windows on a stream of node state packets.

Windows are closed by the watermark and come out in append mode. All rows of a
window leave in the same micro-batch, so statistics that need an order inside a
window run the batch operator on that output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.peers import BUCKET, freshest_peers
from shelfmark.operators.telemetry import (
    WindowProcessor,
    in_windows,
    lag_of,
    percentiles_of_counts,
    shard_overview,
)
from shelfmark.schema import ROUTING_ENTRIES, TELEMETRY_WINDOW
from shelfmark.session import durable
from shelfmark.streaming.state import DeltaTable, run_batches, write_batch

DELAY = "5 seconds"


def _windowed(states: DataFrame, width: str, delay: str, *keys: str):
    return states.withWatermark("ts", delay).groupBy(F.window("ts", width), *keys)


def _start() -> Column:
    return F.col("window.start").alias("window_start")


def stream_state_windows(
    states: DataFrame, width: str = TELEMETRY_WINDOW, delay: str = DELAY
) -> DataFrame:
    """The last packet of each node in each window."""
    rest = ["partition_id", "depth", "leader_id", "is_leader", "num_entries"]
    last = _windowed(states, width, delay, "node_id").agg(
        F.max_by(F.struct("ts", *rest), F.struct("ts", "num_entries")).alias("s")
    )
    return last.select(_start(), "node_id", *(F.col(f"s.{c}") for c in ["ts", *rest]))


def stream_replication_lag(
    states: DataFrame, width: str = TELEMETRY_WINDOW, delay: str = DELAY
) -> DataFrame:
    known = states.filter(F.col("num_entries").isNotNull())
    lag = lag_of(_windowed(known, width, delay))
    return lag.select(_start(), "avg_lag", "max_lag", "min_lag")


def _per_closed_windows(
    windows: DataFrame, finish: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    def each(batch: DataFrame, batch_id: int) -> None:
        # Written first: reading the batch twice would run its stateful part twice.
        write_batch(finish(durable(batch)), path, batch_id)

    return run_batches(windows, each, checkpoint)


def stream_percentile_lag(
    states: DataFrame,
    path: str,
    checkpoint: str,
    width: str = TELEMETRY_WINDOW,
    delay: str = DELAY,
) -> StreamingQuery:
    """Lag percentiles per closed window. The state counts equal values, it keeps no packets."""
    known = states.filter(F.col("num_entries").isNotNull())
    counted = _windowed(known, width, delay, "num_entries").agg(F.count(F.lit(1)).alias("n"))
    return _per_closed_windows(
        counted.select(_start(), "num_entries", "n"),
        lambda batch: percentiles_of_counts(batch, ["window_start"]),
        path,
        checkpoint,
    )


def stream_shard_overview(
    states: DataFrame,
    path: str,
    checkpoint: str,
    width: str = TELEMETRY_WINDOW,
    delay: str = DELAY,
) -> StreamingQuery:
    """Shard overview per closed window, over the last packet of each node."""
    return _per_closed_windows(
        stream_state_windows(states, width, delay),
        lambda batch: shard_overview(batch, ["window_start"]),
        path,
        checkpoint,
    )


def stream_convergence(
    states: DataFrame,
    nodes: int,
    target: int,
    width: str = TELEMETRY_WINDOW,
    delay: str = DELAY,
) -> DataFrame:
    """Windows in which at least ``nodes`` packets are there and all report ``target``."""
    seen = _windowed(states, width, delay).agg(
        F.count(F.lit(1)).alias("packets"),
        F.min("num_entries").alias("least"),
        F.max("num_entries").alias("most"),
        F.count("num_entries").alias("known"),
    )
    same = (F.col("least") == target) & (F.col("most") == target)
    enough = (F.col("packets") >= nodes) & (F.col("known") == F.col("packets"))
    return seen.filter(same & enough).select(_start(), "packets")


def routing_table(path: str, schema: T.StructType) -> DeltaTable:
    """The routing table as deltas: a batch adds the whole of each bucket that it changes, and the
    latest of a bucket counts. ``schema`` is that of the samples."""

    def merge(rows: DataFrame) -> DataFrame:
        latest = rows.groupBy(*BUCKET).agg(F.max("version").alias("version"))
        return rows.join(latest, [*BUCKET, "version"], "left_semi")

    return DeltaTable(path, T.StructType([*schema.fields, T.StructField("version", T.LongType())]), merge)


def stream_freshest_peers(
    samples: DataFrame, path: str, checkpoint: str, limit: int = ROUTING_ENTRIES
) -> StreamingQuery:
    """Keep the routing table up to date; each batch writes the buckets that it touches.

    Samples carry the ``round`` they were taken in; the later round is the younger sample. The
    table (``routing_table``) holds at most ``limit`` peers per bucket, and a peer that fell out can
    only come back with a new sample, so merging a batch into the last version of its buckets
    gives the same as looking at all samples.
    """
    table = routing_table(path, samples.schema)

    def each(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select(*BUCKET).distinct()
        last = table.before(batch.sparkSession, batch_id).join(touched, BUCKET, "left_semi")
        rows = last.select(*batch.columns).unionByName(batch)
        kept = freshest_peers(rows.withColumn("age", -F.col("round")), limit)
        table.add(kept.withColumn("version", F.lit(batch_id).cast("long")), batch_id)

    return run_batches(samples, each, checkpoint)


LATEST_SCHEMA = T.StructType([T.StructField("latest", T.LongType())])


def stream_window_processor(
    states: DataFrame,
    processor: WindowProcessor,
    path: str,
    state_path: str,
    checkpoint: str,
    width: str = TELEMETRY_WINDOW,
    delay: str = DELAY,
) -> StreamingQuery:
    """Run a user's window processor on a stream of packets.

    Each batch adds the partial rows of its own packets to the state, and the results of the
    windows that end at or before the watermark (the latest packet so far, less ``delay``) are
    written to the batch's folder; their partial rows leave the state with its next snapshot. So
    the state holds open windows only, as partial rows. Packets of windows that were closed by an
    earlier batch, and packets without a time, are ignored.
    """
    table = DeltaTable(f"{state_path}/partial", processor.schema, processor.merge)
    marks = DeltaTable(f"{state_path}/latest", LATEST_SCHEMA, lambda rows: rows.agg(F.max("latest").alias("latest")))
    columns = [f.name for f in processor.schema.fields]

    def closed(latest: int | None) -> Column:
        if latest is None:
            return F.lit(False)
        end = F.col("window_start") + F.expr(f"INTERVAL {width}")
        return end <= F.timestamp_micros(F.lit(latest)) - F.expr(f"INTERVAL {delay}")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = marks.before(spark, batch_id).first()[0]
        packets = in_windows(batch, width).filter(F.col("window_start").isNotNull() & ~closed(before))
        marks.add(batch.agg(F.unix_micros(F.max("ts")).alias("latest")), batch_id)
        now = marks.before(spark, batch_id + 1).first()[0]
        table.add(processor.merge(processor.partial(packets)), batch_id)
        # What the batch added is read back as written, so the user's code runs once on a packet.
        added = table.added(spark, batch_id)
        rows = table.before(spark, batch_id, ~closed(before)).select(columns).unionByName(added)
        write_batch(processor.finish(processor.merge(rows.filter(closed(now)))), path, batch_id)

    return run_batches(states, each, checkpoint)
