"""Streams over the given tables.

Each query stages a table (or what Spark derives from it) as files, runs the
stream over all of it, and returns what it wrote. A closing row far in the future
moves the watermark past the data, so every window is closed; it is filtered out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.telemetry import WindowProcessor
from shelfmark.operators.units import lowest_missing
from shelfmark.plans import fixtures as fx
from shelfmark.plans.peer_queries import BUCKET, INVERTED, SAMPLES, _samples
from shelfmark.plans.registry import Query
from shelfmark.plans.telemetry_queries import (
    LAG_SELECT,
    PCT_SELECT,
    RANKED,
    TARGET,
    WIDTH,
    WINDOW,
    overview_sql,
)
from shelfmark.plans.unit_queries import BROKEN, TRACKED, _broken_units
from shelfmark.schema import ID, UNIT
from shelfmark.session import work_dir
from shelfmark.sources import dumps
from shelfmark.sources.generations import file_system
from shelfmark.streaming import ordered, replies, requests, state, telemetry

Spark = SparkSession
CLOSING = "2100-01-01 00:00:00"
# Rounds of the given events are long: minutes lie between two events.
TIMEOUT = "1 HOUR"


def staged(
    spark: Spark,
    rows: DataFrame,
    *closing_columns: str,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Write rows to a new folder and read it as a stream."""
    path = work_dir(spark, "staged")
    rows.write.parquet(path)
    if closing_columns:
        _close(rows, path, closing_columns)
    reader = spark.readStream.schema(rows.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _close(rows: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    last = rows.limit(1).withColumns({c: F.lit(CLOSING).cast("timestamp") for c in columns})
    last.coalesce(1).write.mode("append").parquet(path)


def in_batches(
    spark: Spark, rows: DataFrame, *closing_columns: str, time: str = "ts", batches: int = 3
) -> DataFrame:
    """The same in time order, as about so many micro-batches. All tasks write at once, each a file
    of a range of time; the number of files grows with the table."""
    path = work_dir(spark, "staged")
    # As many files as the scan of the table has tasks, dealt to the batches.
    per_batch = max(1, -(-rows.rdd.getNumPartitions() // batches))
    rows.repartitionByRange(per_batch * batches, time).write.parquet(path)
    _in_name_order(spark, path)
    if closing_columns:
        _close(rows, path, closing_columns)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _in_name_order(spark: Spark, path: str) -> None:
    """A stream takes files by their times; these are set a second apart, in the order of the ranges."""
    system, place = file_system(spark, path)
    files = {s.getPath().getName(): s for s in system.listStatus(place) if s.getPath().getName().startswith("part-")}
    first = min(s.getModificationTime() for s in files.values())
    for i, name in enumerate(sorted(files, reverse=True), 1):
        system.setTimes(files[name].getPath(), first - 1000 * i, -1)


def before_closing(rows: DataFrame, column: str = "window_start") -> DataFrame:
    return rows.filter(F.col(column) < F.lit(CLOSING).cast("timestamp"))


def appended(spark: Spark, stream: DataFrame) -> DataFrame:
    """Run a stream to its end and read its output."""
    path = work_dir(spark, "out")
    state.run_append(stream, path, work_dir(spark, "checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _states(spark: Spark, d: str) -> DataFrame:
    return in_batches(spark, fx.peer_state(spark, d), "ts")


def _state_windows(spark: Spark, d: str) -> DataFrame:
    out = appended(spark, telemetry.stream_state_windows(_states(spark, d), WIDTH))
    return before_closing(out).select("window_start", "node_id", "ts", "leader_id", "num_entries")


def _replication_lag(spark: Spark, d: str) -> DataFrame:
    return before_closing(
        appended(spark, telemetry.stream_replication_lag(_states(spark, d), WIDTH))
    )


def _percentile_lag(spark: Spark, d: str) -> DataFrame:
    path = work_dir(spark, "out")
    telemetry.stream_percentile_lag(
        _states(spark, d), path, work_dir(spark, "checkpoint"), WIDTH
    ).awaitTermination()
    return before_closing(state.read_batches(spark, path).drop("batch"))


def _shard_overview(spark: Spark, d: str) -> DataFrame:
    path = work_dir(spark, "out")
    telemetry.stream_shard_overview(
        _states(spark, d), path, work_dir(spark, "checkpoint"), "1 day"
    ).awaitTermination()
    out = before_closing(state.read_batches(spark, path).drop("batch"))
    return out.withColumnRenamed("full", "full_")


PARTIAL_SCHEMA = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()),
        T.StructField("partition_id", T.LongType()),
        T.StructField("packets", T.LongType()),
        T.StructField("entries", T.LongType()),
        T.StructField("least", T.LongType()),
        T.StructField("most", T.LongType()),
    ]
)


def _spread_partial(packets: DataFrame) -> DataFrame:
    """User code: one partial row of each packet."""
    entries = [F.col("num_entries").alias(c) for c in ("entries", "least", "most")]
    return packets.select(
        "window_start", F.col("partition_id").cast("long"), F.lit(1).cast("long").alias("packets"), *entries
    )


def _spread_merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy("window_start", "partition_id").agg(
        F.sum("packets").alias("packets"),
        F.sum("entries").alias("entries"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
    )


def _spread_finish(rows: DataFrame) -> DataFrame:
    return rows.select(
        "window_start", "partition_id", "packets", "entries", (F.col("most") - F.col("least")).alias("spread")
    )


SPREAD = WindowProcessor(_spread_partial, _spread_merge, _spread_finish, PARTIAL_SCHEMA)


def _stream_processor(spark: Spark, d: str) -> DataFrame:
    path = work_dir(spark, "out")
    telemetry.stream_window_processor(
        _states(spark, d), SPREAD, path, work_dir(spark, "state"), work_dir(spark, "checkpoint"), WIDTH
    ).awaitTermination()
    return before_closing(state.read_batches(spark, path).drop("batch"))


def _convergence(spark: Spark, d: str) -> DataFrame:
    stream = telemetry.stream_convergence(_states(spark, d), 1, TARGET, "1 minute")
    return before_closing(appended(spark, stream))


def _dedup_requests(spark: Spark, d: str) -> DataFrame:
    path = work_dir(spark, "out")
    requests.stream_dedup_requests(
        in_batches(spark, fx.add_requests(spark, d)),
        path,
        work_dir(spark, "state"),
        work_dir(spark, "checkpoint"),
    ).awaitTermination()
    return state.read_batches(spark, path).select("request_id", "event_id")


def _dedup_batch(spark: Spark, d: str) -> DataFrame:
    """A TTL of a day, so that many repeats are dropped."""
    kept = requests.accept_requests(fx.add_requests(spark, d), None, 86_400)
    return kept.select("request_id", "event_id")


def _dedup_sql(ttl_seconds: int) -> str:
    return fx.sql(
        "add_requests",
        "SELECT request_id, event_id FROM chain",
        "r AS (SELECT request_id, event_id, epoch_us(ts) AS t FROM add_requests)",
        f"""following AS (SELECT a.request_id, a.event_id, min_by(b.event_id, (b.t, b.event_id)) AS next_event
FROM r a JOIN r b ON a.request_id = b.request_id AND b.t > a.t + {ttl_seconds * 1_000_000} GROUP BY a.request_id, a.event_id)""",
        """chain AS (SELECT request_id, min_by(event_id, (t, event_id)) AS event_id FROM r GROUP BY request_id
UNION ALL SELECT f.request_id, f.next_event FROM chain c JOIN following f ON f.request_id = c.request_id AND f.event_id = c.event_id)""",
    ).replace("WITH", "WITH RECURSIVE", 1)


def _native_dedup(spark: Spark, d: str) -> DataFrame:
    """With a delay beyond the whole stream: every id comes out once, in whichever batch."""
    stream = in_batches(spark, fx.add_requests(spark, d))
    return appended(spark, requests.native_dedup(stream, ["request_id"], "3650 days")).select("request_id")


def _first_reply(spark: Spark, d: str) -> DataFrame:
    stream = in_batches(spark, fx.replies(spark, d), "ts", batches=4)
    return before_closing(appended(spark, replies.stream_first_reply(stream, TIMEOUT)), "ts")


def _rounds(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Views open a round of their user; all other events of the user are replies."""
    rows = fx.events(spark, d)
    queries = rows.filter("event_type = 'view'").select(
        F.col("user_id").alias("round_id"),
        F.col("ts").alias("query_ts"),
        (F.col("event_id") % 3).alias("expected"),
    )
    answers = rows.filter("event_type <> 'view'").select(
        F.col("user_id").alias("round_id"), (F.col("event_id") % 4).alias("shard_id"), "ts"
    )
    return queries, answers


ROUNDS = [
    "queries AS (SELECT user_id AS round_id, ts AS query_ts, event_id % 3 AS expected FROM events WHERE event_type = 'view')",
    "answers AS (SELECT user_id AS round_id, event_id % 4 AS shard_id, ts FROM events WHERE event_type <> 'view')",
]
IN_TIME = "q.round_id = r.round_id AND r.ts >= q.query_ts AND r.ts <= q.query_ts + INTERVAL 1 HOUR"
JOIN_SQL = f"""WITH {', '.join(ROUNDS)} SELECT q.round_id, query_ts, expected, shard_id, ts
FROM queries q JOIN answers r ON {IN_TIME}"""


def _reply_join(spark: Spark, d: str) -> DataFrame:
    queries, answers = _rounds(spark, d)
    asked, told = in_batches(spark, queries, time="query_ts"), in_batches(spark, answers)
    # What a stream has behind the watermark of both is ignored, so the delay spans a batch.
    return appended(spark, replies.stream_reply_join(asked, told, TIMEOUT, "30 days"))


def _reply_join_batch(spark: Spark, d: str) -> DataFrame:
    return replies.reply_interval_join(*_rounds(spark, d), TIMEOUT)


def _round_timeout(spark: Spark, d: str) -> DataFrame:
    queries, answers = _rounds(spark, d)
    asked = in_batches(spark, queries, "query_ts", time="query_ts")
    out = replies.stream_round_timeout(asked, in_batches(spark, answers, "ts"), TIMEOUT, "30 days")
    return before_closing(appended(spark, out), "query_ts")


# -- ordered commit -------------------------------------------------------------------------


def _arriving(spark: Spark, d: str) -> DataFrame:
    """Entries in order of a hash, some ids lost for good."""
    rows = fx.entries(spark, d).filter(F.col("doc_id") % 97 != 5)
    return rows.select(*ID, "category", "shard_id", "hash")


ARRIVING = "arriving AS (SELECT * FROM entries WHERE doc_id % 97 <> 5)"


def _commit(spark: Spark, d: str) -> tuple[str, str, int]:
    rows = _arriving(spark, d)
    mixed = rows.repartitionByRange(3, F.md5("hash"))
    # Every fourth category arrives twice, so repeats are part of the stream.
    repeats = rows.filter("category = 'Music'").repartitionByRange(3, F.md5("hash"))
    stream = staged(spark, mixed.unionByName(repeats), files_per_batch=1)
    path, state_path = work_dir(spark, "out"), work_dir(spark, "state")
    query = ordered.stream_ordered_commit(stream, path, state_path, work_dir(spark, "checkpoint"))
    query.awaitTermination()
    return path, state_path, query.lastProgress.batchId + 1


def _ordered_commit(spark: Spark, d: str) -> DataFrame:
    path, _, _ = _commit(spark, d)
    return ordered.released(spark, path).select(*ID, "hash")


def _stalled(spark: Spark, d: str) -> DataFrame:
    path, state_path, batches = _commit(spark, d)
    waiting = ordered.held(spark, path, state_path, _arriving(spark, d).schema, batches)
    return ordered.stalled(waiting, ordered.committed(spark, state_path, batches))


PREFIX = """counted AS (SELECT *, row_number() OVER (PARTITION BY epoch_id, leader_id ORDER BY entry_id) - 1 AS rn FROM arriving)"""


def _unit_advance(spark: Spark, d: str) -> DataFrame:
    frontier = lowest_missing(fx.entries(spark, d)).withColumnRenamed("lowest_missing", "next_id")
    reports = _broken_units(spark, d).withColumn("seq", F.lit(0).cast("bigint"))
    stream = staged(spark, reports.repartition(2, *UNIT), files_per_batch=1)
    path = work_dir(spark, "out")
    query = ordered.stream_unit_advance(
        stream, frontier, path, work_dir(spark, "state"), work_dir(spark, "checkpoint")
    )
    query.awaitTermination()
    written = state.read_batches(spark, path)
    last = written.agg(F.max("batch")).scalar()
    return written.filter(F.col("batch") == last).drop("batch")


def _freshest(spark: Spark, d: str) -> DataFrame:
    rows = _samples(spark, d).withColumn("round", F.lit(49) - F.col("age")).drop("age")
    stream = staged(spark, rows.repartition(3, "node_id", "round"), files_per_batch=1)
    path = work_dir(spark, "out")
    query = telemetry.stream_freshest_peers(stream, path, work_dir(spark, "checkpoint"))
    query.awaitTermination()
    table = telemetry.routing_table(path, rows.schema)
    return table.before(spark, query.lastProgress.batchId + 1).select(
        "category_id", "partition_id", "node_id", "depth", "round"
    )


# -- window dumps ---------------------------------------------------------------------------


def _dumped(spark: Spark, d: str) -> str:
    path = work_dir(spark, "dump")
    dumps.write_windows(
        in_batches(spark, fx.peer_state(spark, d)), path, work_dir(spark, "checkpoint"), WIDTH
    ).awaitTermination()
    return path


def _window_dump_write(spark: Spark, d: str) -> DataFrame:
    stored = spark.read.parquet(_dumped(spark, d))
    return stored.select(
        F.col("dump").cast("bigint").alias("dump"), "window_start", "node_id", "num_entries"
    )


def _window_dump_replay(spark: Spark, d: str) -> DataFrame:
    """The dump files go through a stream again, several at a time."""
    replayed = dumps.replay_windows(spark, _dumped(spark, d), files_per_batch=8)
    return appended(spark, replayed.select("dump", "window_start", "node_id", "num_entries"))


DUMP_SQL = fx.sql(
    "peer_state",
    f"""SELECT CAST(floor(epoch(window_start) / (3600 * 50)) AS BIGINT) AS dump, window_start, node_id, num_entries
FROM (SELECT *, {WINDOW} FROM peer_state)""",
)
WINDOW_LATEST = f"""windowed AS (SELECT * FROM (SELECT *, row_number() OVER (
PARTITION BY window_start, node_id ORDER BY ts DESC, num_entries DESC) AS rn FROM (SELECT *, __W__ FROM peer_state)) WHERE rn = 1)"""

QUERIES: dict[str, Query] = {
    "window_dump_write": Query(_window_dump_write, DUMP_SQL),
    "window_dump_replay": Query(_window_dump_replay, DUMP_SQL),
    "stream_state_windows": Query(
        _state_windows,
        fx.sql(
            "peer_state",
            "SELECT window_start, node_id, ts, leader_id, num_entries FROM windowed",
            WINDOW_LATEST.replace("__W__", WINDOW),
        ),
    ),
    "stream_replication_lag": Query(_replication_lag, fx.sql("peer_state", LAG_SELECT)),
    "stream_percentile_lag": Query(_percentile_lag, fx.sql("peer_state", PCT_SELECT, RANKED)),
    "stream_shard_overview": Query(
        _shard_overview,
        fx.sql(
            "peer_state",
            overview_sql("windowed", "window_start, "),
            WINDOW_LATEST.replace("__W__", "date_trunc('day', ts)::TIMESTAMP AS window_start"),
        ),
    ),
    "stream_window_processor": Query(
        _stream_processor,
        fx.sql(
            "peer_state",
            f"""SELECT {WINDOW}, CAST(partition_id AS BIGINT) AS partition_id, count(*) AS packets,
CAST(sum(num_entries) AS BIGINT) AS entries, max(num_entries) - min(num_entries) AS spread FROM peer_state GROUP BY ALL""",
        ),
    ),
    "stream_convergence": Query(
        _convergence,
        fx.sql(
            "peer_state",
            f"""SELECT date_trunc('minute', ts) AS window_start, count(*) AS packets FROM peer_state GROUP BY 1
HAVING count(*) >= 1 AND bool_and(num_entries = {TARGET})""",
        ),
    ),
    "stream_dedup_requests": Query(_dedup_requests, _dedup_sql(300)),
    "dedup_requests_day": Query(_dedup_batch, _dedup_sql(86_400)),
    "stream_dedup_native": Query(
        _native_dedup, fx.sql("add_requests", "SELECT DISTINCT request_id FROM add_requests")
    ),
    "stream_first_reply": Query(
        _first_reply,
        fx.sql(
            "replies",
            """SELECT round_id, shard_id, ts, event_id FROM (SELECT *, row_number() OVER (
PARTITION BY round_id, shard_id ORDER BY ts, event_id) AS rn FROM replies) WHERE rn = 1""",
        ),
    ),
    "reply_interval_join": Query(_reply_join_batch, JOIN_SQL),
    "stream_reply_join": Query(_reply_join, JOIN_SQL),
    "stream_round_timeout": Query(
        _round_timeout,
        f"""WITH {', '.join(ROUNDS)}, counted AS (SELECT q.round_id, query_ts, expected,
count(DISTINCT shard_id) AS replied, count(shard_id) AS hits
FROM queries q LEFT JOIN answers r ON {IN_TIME} GROUP BY q.round_id, query_ts, expected)
SELECT round_id, query_ts, expected <> 0 AND replied >= expected AS complete,
CASE WHEN expected <> 0 AND replied >= expected THEN hits ELSE 0 END AS hits FROM counted""",
    ),
    "stream_ordered_commit": Query(
        _ordered_commit,
        fx.sql(
            "entries",
            "SELECT epoch_id, leader_id, entry_id, hash FROM counted WHERE entry_id = rn",
            ARRIVING,
            PREFIX,
        ),
    ),
    "stream_ordered_commit_stalled": Query(
        _stalled,
        fx.sql(
            "entries",
            """SELECT epoch_id, leader_id, min(entry_id) FILTER (entry_id <> rn) AS held_from,
max(entry_id) FILTER (entry_id <> rn) AS held_to, count(*) FILTER (entry_id <> rn) AS held,
count(*) FILTER (entry_id = rn) AS next_id FROM counted GROUP BY epoch_id, leader_id
HAVING count(*) FILTER (entry_id <> rn) > 0""",
            ARRIVING,
            PREFIX,
        ),
    ),
    "stream_unit_advance": Query(
        _unit_advance,
        fx.sql(
            "units",
            TRACKED,
            BROKEN,
        ),
    ),
    "stream_freshest_peers": Query(
        _freshest,
        fx.sql(
            "peers",
            f"""SELECT {BUCKET}, node_id, depth, 49 - age AS round FROM (SELECT *, row_number() OVER (
PARTITION BY {BUCKET} ORDER BY age, {INVERTED}) AS place FROM (SELECT *, row_number() OVER (
PARTITION BY {BUCKET}, node_id ORDER BY age, num_entries DESC) AS youngest FROM (
SELECT *, max(depth) OVER (PARTITION BY {BUCKET}) AS deepest FROM samples) WHERE depth = deepest)
WHERE youngest = 1) WHERE place <= 20""",
            SAMPLES,
        ),
    ),
}
