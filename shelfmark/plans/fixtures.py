"""Working tables over the given ones: once as DataFrames, once as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.schema import PATTERN_SCHEMA


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def entries_from(documents: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    return documents.select(
        doc,
        F.floor(doc / 100.0).cast("bigint").alias("epoch_id"),
        (F.lit(100) + F.floor(doc / 50.0) % 2).cast("int").alias("leader_id"),
        (doc % 50).alias("entry_id"),
        F.concat(F.lit("g"), doc.cast("string")).alias("global_id"),
        F.concat(F.lit("doc://"), "source", F.lit("/"), doc.cast("string")).alias("url"),
        F.col("text").alias("file_name"),
        F.col("n_chars").alias("file_size"),
        F.expr("TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE").alias("uploaded"),
        F.col("lang").alias("language"),
        F.when(doc % 4 == 0, "Video")
        .when(doc % 4 == 1, "Music")
        .when(doc % 4 == 2, "Books")
        .otherwise("Default")
        .alias("category"),
        (F.floor(doc / 4.0).cast("bigint") % 4).alias("shard_id"),
        F.col("text").alias("description"),
        F.md5("text").alias("hash"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_from(table(spark, sf_dir, "documents"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    newest = rows.agg(F.max("epoch_id")).scalar()
    sized = rows.groupBy("epoch_id", "leader_id").agg(F.count(F.lit(1)).alias("num_entries"))
    return sized.withColumns(
        {
            "status": F.when(F.col("epoch_id") == newest, "ONGOING").otherwise("COMPLETED"),
            "pull_status": F.when(F.col("epoch_id") % 3 == 0, "COMPLETED")
            .when(F.col("epoch_id") % 3 == 1, "PENDING")
            .otherwise("SKIP"),
        }
    )


def replica_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id")
    cols = ["epoch_id", "leader_id", "entry_id", "hash"]
    changed = F.when(F.col("doc_id") % 97 == 0, F.md5(F.concat("hash", F.lit("x")))).otherwise(
        F.col("hash")
    )
    whole = rows.select(F.lit(0).alias("replica_id"), *cols)
    labelled = rows.join(labels, "doc_id").select(F.lit(1).alias("replica_id"), *cols)
    altered = (
        rows.filter(F.col("doc_id") % 10 != 3)
        .withColumn("hash", changed)
        .select(F.lit(2).alias("replica_id"), *cols)
    )
    return whole.unionByName(labelled).unionByName(altered)


def unit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units as each replica reports them: its own row counts, statuses from the catalog."""
    held = replica_entries(spark, sf_dir).groupBy("replica_id", "epoch_id", "leader_id").agg(
        F.count(F.lit(1)).alias("num_entries")
    )
    status = units(spark, sf_dir).select("epoch_id", "leader_id", "status", "pull_status")
    return held.join(status, ["epoch_id", "leader_id"])


def peer_state_from(rows: DataFrame) -> DataFrame:
    leader = F.when(F.col("event_type") != "error", F.col("user_id") % 4)
    return rows.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("node_id"),
        (F.col("user_id") % 4).alias("partition_id"),
        F.lit(2).alias("depth"),
        leader.alias("leader_id"),
        (F.col("user_id") < 4).alias("is_leader"),
        F.floor(F.col("value") * 10).cast("bigint").alias("num_entries"),
    )


def peer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peer_state_from(events(spark, sf_dir))


def search_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = events(spark, sf_dir).filter(F.col("event_type") == "click")
    return clicks.select("ts", F.col("user_id").alias("node_id"), F.col("value").alias("response_ms"))


def add_requests_from(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("request_id"),
    )


def add_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_requests_from(events(spark, sf_dir))


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        node.alias("node_id"),
        (nation % 4).alias("category_id"),
        (F.lit(1) + nation % 2).alias("depth"),
        F.when(nation % 2 == 0, node % 2).otherwise(node % 4).alias("partition_id"),
        F.floor(F.abs("c_acctbal")).cast("bigint").alias("num_entries"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_lg_member"),
        (F.col("c_mktsegment") == "MACHINERY").alias("is_nated"),
        (node % 30).alias("age"),
        (node % 10).alias("last_epoch"),
        (F.lit(100) + node % 2).cast("int").alias("last_leader"),
    )


def part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("file_name"),
        F.col("p_type").alias("category"),
        F.col("p_size").cast("bigint").alias("file_size"),
        F.col("p_brand").alias("language"),
    )


# A reply of a search round: events of one hour form a round, the user's shard replies.
def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.date_trunc("hour", "ts").alias("round_id"),
        (F.col("user_id") % 4).alias("shard_id"),
        "ts",
        "event_id",
    )


# The patterns of the batch search: (id, file name, sizes, dates, language, category,
# description, page start, page size). They cover every clause and their edge cases.
PATTERN_ROWS: list[tuple] = [
    (1, "ing", None, None, None, None, None, None, None, 0, 10),
    (2, "the ou", None, None, None, None, None, None, None, 0, 10),
    (3, "THERE Ea", None, None, None, None, None, None, None, 5, 10),
    (4, None, 500, 2000, None, None, None, None, None, 0, 0),
    (5, None, 4000, 0, None, None, None, None, None, 10, 20),
    (6, None, None, None, "2024-01-01 02:00:00", "2024-01-01 09:30:00", None, None, None, 0, 25),
    (7, None, None, None, None, None, "fr", None, None, 0, 10),
    (8, "an", None, None, None, None, None, "Video", None, 0, 10),
    (9, None, None, None, None, None, None, None, "ther inea", 0, 10),
    (10, None, None, None, None, None, None, None, "Ther Inea", 0, 10),
    (11, None, None, None, None, None, None, None, None, 0, 10),
    (12, "e", None, None, None, None, None, None, None, 5000, 10),
    (13, "in", 100, 5000, None, None, "en", "Music", "ther", 0, 10),
    (14, None, None, None, None, "2024-01-01 05:00:00", "en", "Books", None, 0, 10),
    (15, None, None, None, "2024-01-01 03:00:00", None, None, "Default", None, 0, 10),
    (16, None, 0, 900, "2024-01-01 01:00:00", None, None, None, None, 3, 7),
    (17, "o-n", None, None, None, None, None, None, None, 0, 10),
    (18, "   ", None, None, None, None, None, None, None, 0, 10),
]


def patterns(spark: SparkSession) -> DataFrame:
    """The pattern table. Which patterns there are is part of the query, like its text."""
    text_dates = T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.name.endswith("_ts") else f.dataType)
            for f in PATTERN_SCHEMA.fields
        ]
    )
    rows = spark.createDataFrame(PATTERN_ROWS, text_dates)
    return rows.select(
        *(F.col(f.name).cast(f.dataType).alias(f.name) for f in PATTERN_SCHEMA.fields)
    )


# -- the same as SQL ------------------------------------------------------------------------

ENTRIES_SQL = """entries AS (
SELECT doc_id, CAST(floor(doc_id/100.0) AS BIGINT) AS epoch_id,
CAST(100 + CAST(floor(doc_id/50.0) AS BIGINT) % 2 AS INT) AS leader_id,
doc_id % 50 AS entry_id, concat('g', CAST(doc_id AS VARCHAR)) AS global_id,
concat('doc://', source, '/', CAST(doc_id AS VARCHAR)) AS url, text AS file_name,
n_chars AS file_size, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS uploaded,
lang AS language,
CASE doc_id % 4 WHEN 0 THEN 'Video' WHEN 1 THEN 'Music' WHEN 2 THEN 'Books' ELSE 'Default' END AS category,
CAST(floor(doc_id/4.0) AS BIGINT) % 4 AS shard_id, text AS description, md5(text) AS hash FROM documents)"""

UNITS_SQL = """units AS (
SELECT epoch_id, leader_id, count(*) AS num_entries,
CASE WHEN epoch_id = max(epoch_id) OVER () THEN 'ONGOING' ELSE 'COMPLETED' END AS status,
CASE epoch_id % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'PENDING' ELSE 'SKIP' END AS pull_status
FROM entries GROUP BY epoch_id, leader_id)"""

REPLICAS_SQL = """replica_entries AS (
SELECT 0 AS replica_id, epoch_id, leader_id, entry_id, hash FROM entries
UNION ALL SELECT 1, e.epoch_id, e.leader_id, e.entry_id, e.hash FROM entries e JOIN labels l ON e.doc_id = l.doc_id
UNION ALL SELECT 2, epoch_id, leader_id, entry_id,
CASE WHEN doc_id % 97 = 0 THEN md5(concat(hash, 'x')) ELSE hash END FROM entries WHERE doc_id % 10 <> 3)"""

REPORTS_SQL = """unit_reports AS (
SELECT r.replica_id, r.epoch_id, r.leader_id, r.num_entries, u.status, u.pull_status
FROM (SELECT replica_id, epoch_id, leader_id, count(*) AS num_entries
FROM replica_entries GROUP BY replica_id, epoch_id, leader_id) r JOIN units u USING (epoch_id, leader_id))"""

STATE_SQL = """peer_state AS (
SELECT ts, user_id AS node_id, user_id % 4 AS partition_id, 2 AS depth,
CASE WHEN event_type = 'error' THEN NULL ELSE user_id % 4 END AS leader_id, user_id < 4 AS is_leader,
CAST(floor(value * 10) AS BIGINT) AS num_entries FROM events)"""

LATENCY_SQL = """search_latency AS (
SELECT ts, user_id AS node_id, value AS response_ms FROM events WHERE event_type = 'click')"""

REQUESTS_SQL = """add_requests AS (
SELECT event_id, ts, concat(CAST(user_id AS VARCHAR), ':', event_type) AS request_id FROM events)"""

PEERS_SQL = """peers AS (
SELECT c_custkey AS node_id, c_nationkey % 4 AS category_id, 1 + c_nationkey % 2 AS depth,
CASE WHEN c_nationkey % 2 = 0 THEN c_custkey % 2 ELSE c_custkey % 4 END AS partition_id,
CAST(floor(abs(c_acctbal)) AS BIGINT) AS num_entries, c_mktsegment = 'BUILDING' AS is_lg_member,
c_mktsegment = 'MACHINERY' AS is_nated, c_custkey % 30 AS age, c_custkey % 10 AS last_epoch,
CAST(100 + c_custkey % 2 AS INT) AS last_leader FROM customer)"""

PARTS_SQL = """part_entries AS (
SELECT p_partkey AS id, p_name AS file_name, p_type AS category, CAST(p_size AS BIGINT) AS file_size,
p_brand AS language FROM part)"""

REPLIES_SQL = """replies AS (
SELECT date_trunc('hour', ts) AS round_id, user_id % 4 AS shard_id, ts, event_id FROM events)"""

_NEEDS = {
    "entries": [ENTRIES_SQL],
    "units": [ENTRIES_SQL, UNITS_SQL],
    "replica_entries": [ENTRIES_SQL, REPLICAS_SQL],
    "unit_reports": [ENTRIES_SQL, UNITS_SQL, REPLICAS_SQL, REPORTS_SQL],
    "peer_state": [STATE_SQL],
    "search_latency": [LATENCY_SQL],
    "add_requests": [REQUESTS_SQL],
    "peers": [PEERS_SQL],
    "part_entries": [PARTS_SQL],
    "replies": [REPLIES_SQL],
}


def sql(tables: str | list[str], body: str, *more: str) -> str:
    """Prefix ``body`` with the definitions of the working tables it reads."""
    names = [tables] if isinstance(tables, str) else tables
    parts: list[str] = []
    for name in names:
        parts.extend(p for p in _NEEDS[name] if p not in parts)
    return "WITH " + ",\n".join([*parts, *more]) + "\n" + body


def _sql_value(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + str(value) + "'"


def patterns_sql() -> str:
    rows = ", ".join("(" + ", ".join(_sql_value(v) for v in r) + ")" for r in PATTERN_ROWS)
    names = ", ".join(f.name for f in PATTERN_SCHEMA.fields)
    return f"""patterns AS (SELECT pattern_id, file_name, CAST(min_size AS BIGINT) AS min_size,
CAST(max_size AS BIGINT) AS max_size, CAST(min_ts AS TIMESTAMP) AS min_ts, CAST(max_ts AS TIMESTAMP) AS max_ts,
language, category, description, page_from, page_size FROM (VALUES {rows}) v({names}))"""
