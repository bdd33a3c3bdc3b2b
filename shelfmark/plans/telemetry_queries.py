"""Windowed statistics, their result files, and user functions over windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators import counts, telemetry
from shelfmark.plans import fixtures as fx
from shelfmark.plans.registry import Query
from shelfmark.session import work_dir
from shelfmark.sources import dumps

Spark = SparkSession
# The given events are minutes apart, so the default window of 5 seconds would
# hold single packets.
WIDTH = "1 hour"
# A number of entries that some windows of the given packets agree on.
TARGET = 19
WINDOW = "date_trunc('hour', ts) AS window_start"
LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (
PARTITION BY node_id ORDER BY ts DESC, num_entries DESC) AS rn FROM peer_state) WHERE rn = 1)"""

LAG_SELECT = f"""SELECT {WINDOW}, floor(100.0::DOUBLE * ((count(*) * max(num_entries) - sum(num_entries)) / count(*)) + 0.5) / 100.0::DOUBLE AS avg_lag,
max(num_entries) - min(num_entries) AS max_lag, CAST(0 AS BIGINT) AS min_lag FROM peer_state GROUP BY 1"""
PCT_SELECT = """SELECT window_start, max(lag) FILTER (rn = n * 50 // 100) AS fifty,
max(lag) FILTER (rn = n * 75 // 100) AS seventy_five, max(lag) FILTER (rn = n * 90 // 100) AS ninety FROM ranked GROUP BY window_start"""
RANKED = f"""ranked AS (SELECT window_start, top - num_entries AS lag, n,
row_number() OVER (PARTITION BY window_start ORDER BY num_entries DESC) - 1 AS rn FROM (
SELECT *, max(num_entries) OVER (PARTITION BY window_start) AS top, count(*) OVER (PARTITION BY window_start) AS n
FROM (SELECT *, {WINDOW} FROM peer_state)))"""


def overview_sql(source: str, by: str = "") -> str:
    """Shard overview over ``source``, optionally per the columns of ``by`` (ending in a comma)."""
    keys = f"{by}partition_id, depth"
    return f"""SELECT {keys}, any_value(lid) AS leader_id, any_value(le) AS leader_entries, count(*) AS nodes,
CASE WHEN any_value(lid) IS NOT NULL THEN count(*) FILTER (le <= 0 OR num_entries::DOUBLE / le >= 0.5) END AS half,
CASE WHEN any_value(lid) IS NOT NULL THEN count(*) FILTER (le <= 0 OR num_entries::DOUBLE / le >= 0.75) END AS three_quarters,
CASE WHEN any_value(lid) IS NOT NULL THEN count(*) FILTER (le <= 0 OR num_entries::DOUBLE / le >= 0.99) END AS full_
FROM (SELECT *, max(node_id) FILTER (is_leader) OVER (PARTITION BY {keys}) AS lid,
max(CASE WHEN is_leader THEN num_entries END) OVER (PARTITION BY {keys}) AS le FROM {source}) GROUP BY {keys}"""


def _state(make):
    return lambda spark, d: make(fx.peer_state(spark, d))


def _s(make, body: str, *more: str) -> Query:
    return Query(_state(make), fx.sql("peer_state", body, *more))


def _rename_full(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("full", "full_")


def _lag_json(spark: Spark, d: str) -> DataFrame:
    path = work_dir(spark, "lag")
    dumps.write_lag_json(telemetry.replication_lag(fx.peer_state(spark, d), WIDTH), path)
    return spark.read.schema("time bigint, avgLag double, maxLag bigint, minLag bigint").json(path)


def _pct_json(spark: Spark, d: str) -> DataFrame:
    path = work_dir(spark, "pct")
    dumps.write_pct_json(telemetry.percentile_lag(fx.peer_state(spark, d), WIDTH), path)
    schema = "time bigint, fifty bigint, seventyFive bigint, ninety bigint"
    return spark.read.schema(schema).json(path)


def _shard_csv(spark: Spark, d: str) -> DataFrame:
    path = work_dir(spark, "shards")
    state = telemetry.latest_state(fx.peer_state(spark, d))
    # Partition 3 loses its leader, so that a line with blanks is written.
    state = state.withColumn("is_leader", F.col("is_leader") & (F.col("partition_id") != 3))
    dumps.write_shard_csv(telemetry.shard_overview(state), path, 1704067200000)
    return spark.read.schema(
        "partition_id bigint, depth int, time bigint, leader_entries bigint, nodes bigint, half bigint, "
        "three_quarters bigint, full_ bigint"
    ).csv(path)


def _busiest(batch: pd.DataFrame) -> pd.DataFrame:
    """User code: the largest packet of each window within a batch."""
    top = batch.groupby("window_start", as_index=False)["num_entries"].agg(["max", "size"])
    return top.rename(columns={"max": "largest", "size": "packets"})


def _window_processor(spark: Spark, d: str) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("window_start", T.TimestampType()),
            T.StructField("largest", T.LongType()),
            T.StructField("packets", T.LongType()),
        ]
    )
    return telemetry.register_window_processor(
        fx.peer_state(spark, d),
        lambda rows: rows.groupBy("window_start").agg(
            F.max("largest").alias("largest"), F.sum("packets").alias("packets")
        ),
        WIDTH,
        _busiest,
        schema,
    )


def _final_state(spark: Spark, d: str) -> DataFrame:
    """User code: a node is in its final state, 1, when it ever reached 100 entries in a day."""
    return telemetry.register_final_state(
        telemetry.in_windows(fx.peer_state(spark, d), "1 day"),
        lambda rows: rows.groupBy("window_start", "partition_id", "node_id").agg(
            (F.max("num_entries") >= 100).cast("int").alias("num_entries")
        ),
        nodes=3,
        target=1,
        by=["window_start", "partition_id"],
    )


def _converged(spark: Spark, d: str) -> DataFrame:
    """Windows of a minute whose packets all report the target, which some do."""
    states = telemetry.in_windows(fx.peer_state(spark, d), "1 minute")
    return telemetry.cluster_converged(states, 1, TARGET, ["window_start"])


QUERIES: dict[str, Query] = {
    "replication_lag": _s(lambda df: telemetry.replication_lag(df, WIDTH), LAG_SELECT),
    "percentile_lag": _s(lambda df: telemetry.percentile_lag(df, WIDTH), PCT_SELECT, RANKED),
    "avg_search_response": Query(
        lambda spark, d: telemetry.avg_search_response(fx.search_latency(spark, d), WIDTH).select(
            "window_start", F.round("avg_response", 6).alias("avg_response"), "responses"
        ),
        fx.sql(
            "search_latency",
            f"SELECT {WINDOW}, round(avg(response_ms), 6) AS avg_response, count(*) AS responses FROM search_latency GROUP BY 1",
        ),
    ),
    "window_states": _s(
        lambda df: telemetry.window_states(df, WIDTH).select(
            "window_start", "node_id", "partition_id", "depth", "leader_id", "num_entries"
        ),
        f"SELECT {WINDOW}, node_id, partition_id, depth, leader_id, num_entries FROM peer_state",
    ),
    "latest_state": _s(
        lambda df: telemetry.latest_state(df).select("node_id", "ts", "leader_id", "num_entries"),
        "SELECT node_id, ts, leader_id, num_entries FROM latest",
        LATEST,
    ),
    "shard_overview": _s(
        lambda df: _rename_full(telemetry.shard_overview(telemetry.latest_state(df))),
        overview_sql("latest"),
        LATEST,
    ),
    "cluster_converged": Query(
        _converged,
        fx.sql(
            "peer_state",
            f"""SELECT date_trunc('minute', ts) AS window_start, count(*) >= 1 AND bool_and(num_entries = {TARGET}) AS converged
FROM peer_state GROUP BY 1""",
        ),
    ),
    "entries_per_node_extremes": _s(
        lambda df: counts.entries_per_node_extremes(telemetry.latest_state(df)),
        "SELECT max(num_entries) AS max_entries, min(num_entries) AS min_entries FROM latest",
        LATEST,
    ),
    "lag_json_sink": Query(
        _lag_json,
        fx.sql(
            "peer_state",
            f"""SELECT epoch_ms(window_start) AS time, avg_lag AS "avgLag", max_lag AS "maxLag", min_lag AS "minLag" FROM ({LAG_SELECT})""",
        ),
    ),
    "pct_json_sink": Query(
        _pct_json,
        fx.sql(
            "peer_state",
            f"""SELECT epoch_ms(window_start) AS time, fifty, seventy_five AS "seventyFive", ninety FROM ({PCT_SELECT})""",
            RANKED,
        ),
    ),
    "shard_csv_sink": Query(
        _shard_csv,
        fx.sql(
            "peer_state",
            f"""SELECT partition_id, depth, CASE WHEN leader_id IS NOT NULL THEN 1704067200000 END AS time, leader_entries,
CASE WHEN leader_id IS NOT NULL THEN nodes END AS nodes, half, three_quarters, full_ FROM ({overview_sql('led')})""",
            LATEST,
            "led AS (SELECT * REPLACE (is_leader AND partition_id <> 3 AS is_leader) FROM latest)",
        ),
    ),
    "register_window_processor": Query(
        _window_processor,
        fx.sql(
            "peer_state",
            f"SELECT {WINDOW}, max(num_entries) AS largest, count(*) AS packets FROM peer_state GROUP BY 1",
        ),
    ),
    "register_final_state": Query(
        _final_state,
        fx.sql(
            "peer_state",
            """SELECT window_start, partition_id, count(*) >= 3 AND bool_and(reached) AS converged FROM (
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, partition_id, node_id, max(num_entries) >= 100 AS reached
FROM peer_state GROUP BY 1, 2, 3) GROUP BY window_start, partition_id""",
        ),
    ),
    "window_filter": _s(
        lambda df: telemetry.window_filter(
            telemetry.in_windows(df, WIDTH), F.hour("window_start") >= 12
        ).select("window_start", "node_id", "num_entries"),
        f"SELECT * FROM (SELECT {WINDOW}, node_id, num_entries FROM peer_state) WHERE hour(window_start) >= 12",
    ),
}
