"""Windowed statistics over node state packets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.ids import round2
from shelfmark.schema import TELEMETRY_WINDOW

PERCENTILES = {"fifty": 50, "seventy_five": 75, "ninety": 90}


def in_windows(states: DataFrame, width: str = TELEMETRY_WINDOW, ts: str = "ts") -> DataFrame:
    """Add the start of the tumbling window of each packet."""
    return states.withColumn("window_start", F.window(ts, width).getField("start"))


def latest_state(states: DataFrame, by: Sequence[str] = ("node_id",)) -> DataFrame:
    """The last packet of every node."""
    rest = [c for c in states.columns if c not in (*by, "ts")]
    last = states.groupBy(*by).agg(
        F.max_by(F.struct("ts", *rest), F.struct("ts", "num_entries")).alias("_s")
    )
    return last.select(*by, "_s.*")


def window_states(states: DataFrame, width: str = TELEMETRY_WINDOW) -> DataFrame:
    """All packets with their window, one row each.

    The rows of a window are not gathered into a list: a window has no size limit.
    """
    return in_windows(states, width)


def replication_lag(states: DataFrame, width: str = TELEMETRY_WINDOW) -> DataFrame:
    """Per window the mean and largest distance to the fullest node.

    The mean follows from count, maximum and sum, so one grouping is enough. The
    least lag is the fullest node compared with itself: 0.
    """
    known = states.filter(F.col("num_entries").isNotNull())
    return lag_of(in_windows(known, width).groupBy("window_start"))


def lag_of(grouped: GroupedData) -> DataFrame:
    n, top = F.count("num_entries"), F.max("num_entries")
    mean = (n * top - F.sum("num_entries")) / n
    return grouped.agg(
        round2(mean).alias("avg_lag"),
        (top - F.min("num_entries")).alias("max_lag"),
        F.lit(0).cast("bigint").alias("min_lag"),
    )


def percentile_lag(states: DataFrame, width: str = TELEMETRY_WINDOW) -> DataFrame:
    """Per window the lag at the sorted positions n * p / 100, for 50, 75 and 90."""
    counts = (
        in_windows(states, width)
        .filter(F.col("num_entries").isNotNull())
        .groupBy("window_start", "num_entries")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return percentiles_of_counts(counts, ["window_start"])


def percentiles_of_counts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Lag percentiles from (group, num_entries, n).

    Equal values are counted before any ordering, so the window sees distinct
    values and not packets.
    """
    from_top = Window.partitionBy(*groups).orderBy(F.desc("num_entries"))
    upto = from_top.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    ranked = counts.select(
        *groups,
        "num_entries",
        F.sum("n").over(upto).alias("upto"),
        F.sum("n").over(whole).alias("total"),
        F.max("num_entries").over(whole).alias("top"),
    )

    def at(p: int) -> Column:
        # The first value from the top whose running count passes the position.
        passed = F.col("upto") > F.floor(F.col("total") * p / 100)
        return F.min(F.when(passed, F.col("top") - F.col("num_entries")))

    return ranked.groupBy(*groups).agg(*(at(p).alias(name) for name, p in PERCENTILES.items()))


def avg_search_response(latencies: DataFrame, width: str = TELEMETRY_WINDOW) -> DataFrame:
    """Per window the true mean response time and the number of responses."""
    return in_windows(latencies, width).groupBy("window_start").agg(
        F.avg("response_ms").alias("avg_response"), F.count("response_ms").alias("responses")
    )


def shard_overview(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per shard: leader, its entries, nodes, and how many hold 50, 75 and 99 % of them.

    One row per node is expected. If several nodes claim to lead, the highest id
    counts. A leader without entries puts all nodes in every class; a shard without
    a leader has nulls. Equal entry counts are combined before the leader is joined.
    """
    shard = [*by, "partition_id", "depth"]
    leads = F.col("is_leader")
    counts = states.groupBy(*shard, "num_entries").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(leads, F.struct("node_id", "num_entries"))).alias("lead"),
    )
    leaders = counts.groupBy(*shard).agg(F.max("lead").alias("leader"))
    held = F.col("leader.num_entries")
    share = F.col("num_entries") / F.when(held > 0, held)

    def holding(least: float) -> Column:
        enough = (held <= 0) | (share >= least)
        return F.when(
            F.max("leader").isNotNull(), F.sum(F.when(enough, F.col("n")).otherwise(0))
        )

    return (
        counts.join(leaders, shard)
        .groupBy(*shard)
        .agg(
            F.max("leader.node_id").alias("leader_id"),
            F.max("leader.num_entries").alias("leader_entries"),
            F.sum("n").alias("nodes"),
            holding(0.5).alias("half"),
            holding(0.75).alias("three_quarters"),
            holding(0.99).alias("full"),
        )
    )


def cluster_converged(
    states: DataFrame, nodes: int, target: int | Column, by: Sequence[str] = ()
) -> DataFrame:
    """True when at least ``nodes`` rows are there and all hold ``target`` entries."""
    wanted = F.lit(target) if isinstance(target, int) else target
    converged = (F.count(F.lit(1)) >= nodes) & F.coalesce(
        F.bool_and(F.col("num_entries") == wanted), F.lit(False)
    )
    return states.groupBy(*by).agg(converged.alias("converged"))


# -- user functions ------------------------------------------------------------------------


@dataclass(frozen=True)
class WindowProcessor:
    """A user-defined aggregate over telemetry windows, in three steps that bound what a task holds.

    ``partial`` turns packets (with ``window_start``) into partial rows of ``schema``, which holds
    ``window_start``; it may run on any part of a window's packets. ``merge`` turns partial rows
    into fewer of the same columns, and must not depend on their order or on what was merged
    before. ``finish`` makes the result rows from the merged rows of whole windows. A partial
    step in Python is ``python_partial``.
    """

    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame]
    schema: T.StructType


def python_partial(
    run: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> Callable[[DataFrame], DataFrame]:
    """A partial step that hands bounded Arrow batches of packets to a pandas function."""

    def each(batches):
        for batch in batches:
            yield run(batch)

    return lambda rows: rows.mapInPandas(each, schema)


def process_windows(
    states: DataFrame, processor: WindowProcessor, width: str = TELEMETRY_WINDOW
) -> DataFrame:
    """Run a window processor over a table of packets."""
    return processor.finish(processor.merge(processor.partial(in_windows(states, width))))


def register_window_processor(
    states: DataFrame,
    combine: Callable[[DataFrame], DataFrame],
    width: str = TELEMETRY_WINDOW,
    partial: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    partial_schema: T.StructType | str | None = None,
) -> DataFrame:
    """Run a user-defined processor over telemetry windows.

    ``combine`` maps the windowed packets (with ``window_start``) to result rows. If
    it needs Python, ``partial`` turns bounded Arrow batches of packets into partial
    rows first, and ``combine`` groups those: no task ever holds a whole window.
    ``WindowProcessor`` is the form that also runs on a stream.
    """
    rows = in_windows(states, width)
    if partial is not None:
        rows = python_partial(partial, partial_schema)(rows)
    return combine(rows)


def register_final_state(
    states: DataFrame,
    to_state: Callable[[DataFrame], DataFrame],
    nodes: int,
    target: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """Turn packets into state rows with a user function and compare them with a target."""
    return cluster_converged(to_state(states), nodes, target, by)


def window_filter(windowed: DataFrame, keep: Column) -> DataFrame:
    """Keep the window rows that satisfy a user predicate."""
    return windowed.filter(keep)
