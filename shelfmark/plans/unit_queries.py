"""Counts, entry ids, the unit timeline, replica comparison and shard splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import counts, replicas, shards, units
from shelfmark.plans import fixtures as fx
from shelfmark.plans.registry import Query
from shelfmark.schema import ID, SHARD, UNIT

Spark = SparkSession
IDS = "epoch_id, leader_id, entry_id"
TUPLE = f"({IDS})"
UNIT_KEY = "(epoch_id, leader_id)"
MEDIAN = (1, 101, 7)
THRESHOLD = 50


def _entries(make):
    return lambda spark, d: make(fx.entries(spark, d))


def _units(make):
    return lambda spark, d: make(fx.units(spark, d))


def _e(make, body: str, *more: str) -> Query:
    return Query(_entries(make), fx.sql("entries", body, *more))


def _u(make, body: str, *more: str) -> Query:
    return Query(_units(make), fx.sql("units", body, *more))


# -- ids --------------------------------------------------------------------------------


def _assign(spark: Spark, d: str) -> DataFrame:
    """New ids for all entries in order of their hash, 40 per container."""
    rows = fx.entries(spark, d).select(*SHARD, "doc_id", "hash")
    return units.assign_entry_ids(rows, ["hash", "doc_id"], base_epoch=5, container=40)


def _assign_lines(spark: Spark, d: str) -> DataFrame:
    """Ids for order lines. Three shards are uneven: one holds half of all rows."""
    rows = fx.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("category"),
        F.col("l_linestatus").alias("shard_id"),
        "l_orderkey",
        "l_linenumber",
        "l_shipdate",
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    return units.assign_entry_ids(rows, order).select(
        "category", "shard_id", "l_orderkey", "l_linenumber", "epoch_id", "entry_id"
    )


REPLICA_UNIT = ["replica_id", *UNIT]


def _broken_units(spark: Spark, d: str) -> DataFrame:
    """Units with a hole in the epochs (epoch 4) and one lone leader per sixth epoch."""
    rows = fx.units(spark, d)
    lone = (F.col("epoch_id") % 6 == 5) & (F.col("leader_id") == 101)
    return rows.filter((F.col("epoch_id") != 4) & ~lone)


BROKEN = """broken AS (SELECT * FROM units WHERE epoch_id <> 4 AND NOT (epoch_id % 6 = 5 AND leader_id = 101))"""


# All entries are committed, so a unit is done when it is closed or skipped. The first
# one that is not done is tracked, else the last one.
TRACKED = """SELECT epoch_id, leader_id, num_entries AS next_id, num_entries, status, pull_status FROM (
SELECT *, status = 'COMPLETED' OR pull_status = 'SKIP' AS done FROM broken
WHERE epoch_id <= (SELECT min(epoch_id) FROM broken b WHERE epoch_id + 1 NOT IN (SELECT epoch_id FROM broken)))
ORDER BY done, CASE WHEN done THEN -epoch_id ELSE epoch_id END, CASE WHEN done THEN -leader_id ELSE leader_id END LIMIT 1"""


def _reports_in_sequence(spark: Spark, d: str) -> DataFrame:
    """Unit reports numbered by replica, as they would arrive."""
    rows = fx.unit_reports(spark, d)
    late = F.when(F.col("replica_id") == 0, "ONGOING").otherwise(F.col("status"))
    return rows.withColumns({"seq": F.col("replica_id"), "status": late})


def _copied_reports(spark: Spark, d: str) -> DataFrame:
    """Three replicas report all units; one lacks some, and one sees other sizes."""
    copies = fx.units(spark, d).withColumn("replica_id", F.explode(F.array(*map(F.lit, range(3)))))
    lacking = (F.col("replica_id") == 1) & (F.col("epoch_id") % 5 == 2)
    other = (F.col("replica_id") == 2) & (F.col("epoch_id") % 7 == 3)
    size = F.when(other, F.col("num_entries") - 1).otherwise(F.col("num_entries"))
    return copies.filter(~lacking).withColumn("num_entries", size)


COPIED = """copied AS (SELECT replica_id, epoch_id, leader_id, status, CASE WHEN replica_id = 2 AND epoch_id % 7 = 3
THEN num_entries - 1 ELSE num_entries END AS num_entries FROM units, (VALUES (0), (1), (2)) r(replica_id)
WHERE NOT (replica_id = 1 AND epoch_id % 5 = 2))"""


def _asked_units(spark: Spark, d: str) -> DataFrame:
    """Units of all orders' customers, half of them unknown."""
    orders = fx.table(spark, d, "orders")
    return orders.select(
        (F.col("o_custkey") % 20).alias("epoch_id"),
        (F.lit(100) + F.col("o_orderkey") % 3).cast("int").alias("leader_id"),
    ).distinct()


def _tracked(spark: Spark, d: str) -> DataFrame:
    committed = units.lowest_missing(
        fx.replica_entries(spark, d).filter("replica_id = 0")
    ).withColumnRenamed("lowest_missing", "next_id")
    return units.tracked_unit(_broken_units(spark, d), committed)


# -- shards -----------------------------------------------------------------------------


def _placed(spark: Spark, d: str) -> DataFrame:
    return fx.entries(spark, d).select(
        "doc_id",
        *ID,
        "category",
        F.col("shard_id").alias("partition_id"),
        F.lit(2).alias("depth"),
    )


def _shard_split(spark: Spark, d: str) -> DataFrame:
    return shards.shard_split(_placed(spark, d), THRESHOLD)


def _until_fits(spark: Spark, d: str) -> DataFrame:
    placement, _ = shards.shard_until_fits(_placed(spark, d), THRESHOLD)
    return placement


def _until_fits_sizes(spark: Spark, d: str) -> DataFrame:
    """Sizes after the splits, and which shards are stuck."""
    placement, stuck = shards.shard_until_fits(_placed(spark, d), THRESHOLD)
    shard = ["category", "partition_id", "depth"]
    sizes = placement.groupBy(*shard).agg(F.sum("num_entries").alias("num_entries"))
    marked = stuck.select(*shard, F.lit(True).alias("stuck"))
    return sizes.join(marked, shard, "left").withColumn(
        "stuck", F.coalesce("stuck", F.lit(False))
    )


def _until_fits_sql(body: str) -> str:
    """Fifteen rounds over the unit counts of all shards."""
    shard = "PARTITION BY category, partition_id, depth"
    return fx.sql(
        "entries",
        body,
        f"""rounds AS (SELECT 0 AS round, category, shard_id AS partition_id, CAST(2 AS INTEGER) AS depth, epoch_id, leader_id,
count(*) AS num_entries, false AS stuck FROM entries GROUP BY category, shard_id, epoch_id, leader_id
UNION ALL
SELECT round + 1, category,
CASE WHEN due AND median > first AND unit < median THEN partition_id + (CAST(1 AS BIGINT) << depth) ELSE partition_id END,
CASE WHEN due AND median > first THEN depth + 1 ELSE depth END, epoch_id, leader_id, num_entries,
stuck OR (due AND median = first)
FROM (SELECT *, size >= {THRESHOLD} AND depth < 15 AND NOT any_stuck AS due,
max(CASE WHEN upto > size // 2 AND upto - num_entries <= size // 2 THEN unit END) OVER ({shard}) AS median
FROM (SELECT *, CAST(sum(num_entries) OVER ({shard}) AS BIGINT) AS size, min(unit) OVER ({shard}) AS first,
CAST(sum(num_entries) OVER ({shard} ORDER BY unit) AS BIGINT) AS upto, bool_or(stuck) OVER ({shard}) AS any_stuck
FROM (SELECT *, epoch_id * 1000 + leader_id AS unit FROM rounds WHERE round < 15))))""",
    ).replace("WITH", "WITH RECURSIVE", 1)


MEDIANS = f"""medians AS (SELECT category, shard_id, n, epoch_id AS me, leader_id AS ml, entry_id AS mi FROM (
SELECT *, count(*) OVER (PARTITION BY category, shard_id) AS n,
row_number() OVER (PARTITION BY category, shard_id ORDER BY {IDS}) AS rn FROM entries) WHERE rn = n // 2 + 1)"""


def _skip(keep_low: bool):
    return lambda spark, d: shards.skip_list(_broken_units(spark, d), (1, 100), (2, 101, 3), keep_low)


SKIP_BASE = f"""ahead AS (SELECT * FROM broken WHERE epoch_id * 1000 + leader_id >= 1100 AND epoch_id <= (
SELECT min(epoch_id) FROM broken b WHERE epoch_id >= 1 AND epoch_id + 1 NOT IN (SELECT epoch_id FROM broken)))"""


def _mark_skip(spark: Spark, d: str) -> DataFrame:
    rows = _broken_units(spark, d)
    return units.mark_skip(rows, shards.skip_list(rows, (1, 100), (2, 101, 3), True))


QUERIES: dict[str, Query] = {
    # -- counts ---------------------------------------------------------------------------
    "count_all": _e(counts.count_all, "SELECT count(*) AS n FROM entries"),
    "count_app_entries": _e(
        counts.count_app_entries, "SELECT count(*) AS n FROM entries WHERE epoch_id >= 0"
    ),
    "count_actual": _e(
        counts.count_actual, "SELECT count(*) AS n FROM entries WHERE entry_id <> 0"
    ),
    "count_markers": _e(
        counts.count_markers,
        "SELECT count(*) AS n FROM (SELECT DISTINCT epoch_id, leader_id FROM entries)",
    ),
    "min_max_id": Query(
        lambda spark, d: counts.min_max_id(fx.part_entries(spark, d)),
        fx.sql(
            "part_entries",
            "SELECT coalesce(min(id), 0) AS min_id, coalesce(max(id), 0) AS max_id FROM part_entries",
        ),
    ),
    "min_id": Query(
        lambda spark, d: counts.min_max_id(fx.part_entries(spark, d)).select("min_id"),
        fx.sql("part_entries", "SELECT coalesce(min(id), 0) AS min_id FROM part_entries"),
    ),
    "max_id": Query(
        lambda spark, d: counts.min_max_id(fx.part_entries(spark, d)).select("max_id"),
        fx.sql("part_entries", "SELECT coalesce(max(id), 0) AS max_id FROM part_entries"),
    ),
    "last_marker": _e(
        counts.last_marker,
        "SELECT epoch_id, leader_id FROM entries ORDER BY epoch_id DESC, leader_id DESC LIMIT 1",
    ),
    "last_unit": _u(
        counts.last_unit,
        "SELECT epoch_id, leader_id, num_entries FROM units ORDER BY epoch_id DESC, leader_id DESC, num_entries DESC LIMIT 1",
    ),
    "median_id": _e(
        lambda df: counts.median_id(df).select(*ID),
        f"""SELECT {IDS} FROM (SELECT *, row_number() OVER (ORDER BY {IDS}) AS rn, count(*) OVER () AS n FROM entries
WHERE epoch_id >= 0) WHERE rn = n // 2 + 1""",
    ),
    "median_id_per_shard": _e(
        lambda df: counts.median_id(df, SHARD).select(*SHARD, *ID, "total"),
        "SELECT category, shard_id, me AS epoch_id, ml AS leader_id, mi AS entry_id, n AS total FROM medians",
        MEDIANS,
    ),
    "unit_sizes": _e(
        counts.unit_sizes,
        "SELECT epoch_id, leader_id, count(*) AS num_entries FROM entries GROUP BY epoch_id, leader_id",
    ),
    "unit_expected_size": Query(
        lambda spark, d: counts.unit_expected_size(
            fx.units(spark, d).withColumn("num_entries", F.col("num_entries") - 20),
            fx.replica_entries(spark, d).filter("replica_id = 1"),
        ),
        fx.sql(
            ["units", "replica_entries"],
            """SELECT u.epoch_id, u.leader_id, greatest(u.num_entries - 20, coalesce(max(r.entry_id) + 1, 0)) AS num_entries
FROM units u LEFT JOIN (SELECT * FROM replica_entries WHERE replica_id = 1) r USING (epoch_id, leader_id)
GROUP BY u.epoch_id, u.leader_id, u.num_entries""",
        ),
    ),
    "latest_unit": Query(
        lambda spark, d: counts.latest_unit(_reports_in_sequence(spark, d)),
        fx.sql(
            "unit_reports",
            """SELECT epoch_id, leader_id, num_entries, status, first_pull AS pull_status FROM (
SELECT *, row_number() OVER (PARTITION BY epoch_id, leader_id ORDER BY num_entries DESC, replica_id DESC) AS rn,
first_value(pull_status) OVER (PARTITION BY epoch_id, leader_id ORDER BY replica_id) AS first_pull FROM (
SELECT * EXCLUDE status, CASE WHEN replica_id = 0 THEN 'ONGOING' ELSE status END AS status FROM unit_reports)) WHERE rn = 1""",
        ),
    ),
    "id_ranges": _e(
        lambda df: counts.id_ranges(df, "doc_id"),
        """SELECT category, shard_id, min(doc_id) AS min_id, max(doc_id) AS max_id,
abs(max(doc_id) - min(doc_id)) AS id_span FROM entries GROUP BY category, shard_id""",
    ),
    "duplicate_ids": Query(
        lambda spark, d: counts.duplicate_ids(fx.replica_entries(spark, d), "entry_id", UNIT),
        fx.sql(
            "replica_entries",
            """SELECT epoch_id, leader_id, entry_id, count(*) AS copies FROM replica_entries
GROUP BY epoch_id, leader_id, entry_id HAVING count(*) > 1""",
        ),
    ),
    "add_time_stats": Query(
        lambda spark, d: counts.add_time_stats(
            fx.events(spark, d).select(
                "ts", F.col("event_id").alias("add_id"), F.floor(F.col("value") * 1000).alias("millis")
            )
        ),
        """SELECT min(millis) AS best, max(millis) AS worst, (SELECT CAST(floor(sum(millis) / count(*)) AS BIGINT) FROM (
SELECT CAST(floor(value * 1000) AS BIGINT) AS millis FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)) AS mean_last
FROM (SELECT CAST(floor(value * 1000) AS BIGINT) AS millis FROM events)""",
    ),
    "add_request_counts": Query(
        lambda spark, d: counts.add_request_counts(
            fx.events(spark, d), F.col("event_type") == "error", F.col("event_type") == "purchase"
        ),
        """SELECT count(*) AS received, count(*) FILTER (event_type = 'error') AS failed,
count(*) FILTER (event_type = 'purchase') AS added FROM events""",
    ),
    "shard_due": _e(
        lambda df: counts.shard_due(df, 62),
        """SELECT category, shard_id, count(*) AS n FROM entries WHERE entry_id <> 0
GROUP BY category, shard_id HAVING count(*) >= 62""",
    ),
    "partition_counts": _e(
        counts.partition_counts,
        "SELECT category, count(DISTINCT shard_id) AS shards FROM entries GROUP BY category",
    ),
    # -- ids ------------------------------------------------------------------------------
    "assign_entry_ids": Query(
        _assign,
        fx.sql(
            "entries",
            """SELECT category, shard_id, doc_id, hash, 5 + rn // 40 AS epoch_id, rn % 40 AS entry_id FROM (
SELECT *, row_number() OVER (PARTITION BY category, shard_id ORDER BY hash, doc_id) - 1 AS rn
FROM (SELECT category, shard_id, doc_id, hash FROM entries))""",
        ),
    ),
    "assign_entry_ids_lines": Query(
        _assign_lines,
        """SELECT category, shard_id, l_orderkey, l_linenumber, rn // 1000 AS epoch_id, rn % 1000 AS entry_id FROM (
SELECT l_returnflag AS category, l_linestatus AS shard_id, l_orderkey, l_linenumber,
row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS rn FROM lineitem)""",
    ),
    "contiguous_prefix": Query(
        lambda spark, d: units.contiguous_prefix(fx.replica_entries(spark, d), REPLICA_UNIT),
        fx.sql(
            "replica_entries",
            """SELECT replica_id, epoch_id, leader_id, count(*) FILTER (entry_id = rn) AS lowest_missing,
count(*) FILTER (entry_id <> rn) AS stranded FROM (SELECT *, row_number() OVER (
PARTITION BY replica_id, epoch_id, leader_id ORDER BY entry_id) - 1 AS rn FROM replica_entries)
GROUP BY replica_id, epoch_id, leader_id""",
        ),
    ),
    "stranded_ids": Query(
        lambda spark, d: units.stranded_ids(fx.replica_entries(spark, d), REPLICA_UNIT).select(
            "replica_id", *ID
        ),
        fx.sql(
            "replica_entries",
            f"""SELECT replica_id, {IDS} FROM (SELECT *, row_number() OVER (
PARTITION BY replica_id, epoch_id, leader_id ORDER BY entry_id) - 1 AS rn FROM replica_entries) WHERE entry_id <> rn""",
        ),
    ),
    "gap_report": Query(
        lambda spark, d: units.gap_report(fx.replica_entries(spark, d), REPLICA_UNIT),
        fx.sql(
            "replica_entries",
            """SELECT replica_id, epoch_id, leader_id, prev + 1 AS gap_from, entry_id - 1 AS gap_to FROM (
SELECT *, coalesce(lag(entry_id) OVER (PARTITION BY replica_id, epoch_id, leader_id ORDER BY entry_id), -1) AS prev
FROM replica_entries) WHERE entry_id > prev + 1""",
        ),
    ),
    # -- timeline ---------------------------------------------------------------------------
    "next_unit": Query(
        lambda spark, d: units.next_unit(_broken_units(spark, d)),
        fx.sql(
            "units",
            """SELECT * EXCLUDE (e, l), CASE WHEN e <= epoch_id + 1 THEN e END AS next_epoch,
CASE WHEN e <= epoch_id + 1 THEN l END AS next_leader FROM (
SELECT *, lead(epoch_id) OVER w AS e, lead(leader_id) OVER w AS l FROM broken
WINDOW w AS (ORDER BY epoch_id, leader_id, num_entries))""",
            BROKEN,
        ),
    ),
    "next_pending_unit": Query(
        lambda spark, d: units.next_pending_unit(_broken_units(spark, d)),
        fx.sql(
            "units",
            """SELECT * EXCLUDE (e, l, run, last), CASE WHEN e <= last THEN e END AS next_epoch, CASE WHEN e <= last THEN l END AS next_leader FROM (
SELECT *, first_value(CASE WHEN pull_status = 'PENDING' THEN epoch_id END IGNORE NULLS) OVER w AS e,
first_value(CASE WHEN pull_status = 'PENDING' THEN leader_id END IGNORE NULLS) OVER w AS l,
max(epoch_id) OVER (PARTITION BY run) AS last FROM (
SELECT *, epoch_id - dense_rank() OVER (ORDER BY epoch_id) AS run FROM broken)
WINDOW w AS (ORDER BY epoch_id, leader_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""",
            BROKEN,
        ),
    ),
    "next_units_k": Query(
        lambda spark, d: units.next_units(_broken_units(spark, d), (0, 101), 5),
        fx.sql(
            "units",
            f"""SELECT * REPLACE ('PENDING' AS pull_status) FROM broken WHERE {UNIT_KEY} > (0, 101) AND epoch_id <= (
SELECT min(epoch_id) FROM broken b WHERE epoch_id + 1 NOT IN (SELECT epoch_id FROM broken))
ORDER BY epoch_id, leader_id LIMIT 5""",
            BROKEN,
        ),
    ),
    "first_unit": _u(
        units.first_unit,
        "SELECT epoch_id, leader_id, num_entries FROM units WHERE epoch_id = 0 ORDER BY leader_id, num_entries LIMIT 1",
    ),
    "timeline_safe_prefix": Query(
        lambda spark, d: units.timeline_safe_prefix(_broken_units(spark, d)),
        fx.sql(
            "units",
            "SELECT *, dense_rank() OVER (ORDER BY epoch_id) - 1 = epoch_id AS safe FROM broken",
            BROKEN,
        ),
    ),
    "unit_exists": Query(
        lambda spark, d: units.unit_exists(_asked_units(spark, d), fx.units(spark, d)),
        fx.sql(
            "units",
            """SELECT a.epoch_id, a.leader_id, u.epoch_id IS NOT NULL AS known FROM (
SELECT DISTINCT o_custkey % 20 AS epoch_id, CAST(100 + o_orderkey % 3 AS INT) AS leader_id FROM orders) a
LEFT JOIN units u ON u.epoch_id = a.epoch_id AND u.leader_id = a.leader_id""",
        ),
    ),
    "tracked_unit": Query(
        _tracked,
        fx.sql(
            "units",
            TRACKED,
            BROKEN,
        ),
    ),
    # -- replicas ---------------------------------------------------------------------------
    "common_hashes": Query(
        lambda spark, d: replicas.common_hashes(fx.replica_entries(spark, d), 3),
        fx.sql(
            "replica_entries",
            f"""SELECT {IDS}, hash FROM replica_entries WHERE replica_id = 0
INTERSECT SELECT {IDS}, hash FROM replica_entries WHERE replica_id = 1
INTERSECT SELECT {IDS}, hash FROM replica_entries WHERE replica_id = 2""",
        ),
    ),
    "common_units": Query(
        lambda spark, d: replicas.common_units(_copied_reports(spark, d), 3),
        fx.sql(
            "units",
            """SELECT epoch_id, leader_id, num_entries FROM copied WHERE status = 'COMPLETED'
GROUP BY epoch_id, leader_id, num_entries HAVING count(DISTINCT replica_id) = 3""",
            COPIED,
        ),
    ),
    "ongoing_unit_agreed": Query(
        lambda spark, d: replicas.ongoing_unit_agreed(fx.unit_reports(spark, d), 3),
        fx.sql(
            "unit_reports",
            """SELECT epoch_id, leader_id, min(num_entries) AS num_entries FROM unit_reports WHERE status = 'ONGOING'
GROUP BY epoch_id, leader_id HAVING count(DISTINCT replica_id) = 3""",
        ),
    ),
    "missing_entries": Query(
        lambda spark, d: replicas.missing_entries(fx.replica_entries(spark, d), 0, 1),
        fx.sql(
            "replica_entries",
            f"""SELECT {IDS} FROM replica_entries WHERE replica_id = 0
EXCEPT SELECT {IDS} FROM replica_entries WHERE replica_id = 1""",
        ),
    ),
    "hash_mismatch": Query(
        lambda spark, d: replicas.hash_mismatch(fx.replica_entries(spark, d), 0, 2),
        fx.sql(
            "replica_entries",
            f"""SELECT {IDS}, a.hash AS hash_a, b.hash AS hash_b FROM replica_entries a JOIN replica_entries b
USING ({IDS}) WHERE a.replica_id = 0 AND b.replica_id = 2 AND a.hash <> b.hash""",
        ),
    ),
    "buffer_minus_units": Query(
        lambda spark, d: replicas.buffer_minus_units(
            fx.units(spark, d), _broken_units(spark, d)
        ),
        fx.sql(
            "units",
            "SELECT * FROM units u WHERE NOT EXISTS (SELECT 1 FROM broken b WHERE b.epoch_id = u.epoch_id AND b.leader_id = u.leader_id)",
            BROKEN,
        ),
    ),
    # -- shards -----------------------------------------------------------------------------
    "split_keep_low": _e(
        lambda df: shards.split_keep_low(df, MEDIAN).select(*ID),
        f"SELECT {IDS} FROM entries WHERE NOT ((epoch_id = 1 AND leader_id >= 101) OR epoch_id > 1)",
    ),
    "split_keep_high": _e(
        lambda df: shards.split_keep_high(df, MEDIAN).select(*ID),
        f"SELECT {IDS} FROM entries WHERE NOT (epoch_id < 1 OR (epoch_id = 1 AND leader_id < 101))",
    ),
    "split_keep_low_markers": _e(
        lambda df: shards.split_keep_low_markers(df, MEDIAN).select(*ID),
        f"SELECT {IDS} FROM entries WHERE NOT (((epoch_id = 1 AND leader_id >= 101) OR epoch_id > 1) AND entry_id <> 0)",
    ),
    "split_keep_high_markers": _e(
        lambda df: shards.split_keep_high_markers(df, MEDIAN).select(*ID),
        f"SELECT {IDS} FROM entries WHERE NOT ((epoch_id < 1 OR (epoch_id = 1 AND leader_id < 101)) AND entry_id <> 0)",
    ),
    "split_buffer": _e(
        lambda df: shards.split_buffer(df, MEDIAN, keep_low=False)
        .select(*ID)
        .withColumn("kept", F.lit("high"))
        .unionByName(
            shards.split_buffer(df, MEDIAN, keep_low=True).select(*ID).withColumn("kept", F.lit("low"))
        ),
        f"""SELECT {IDS}, 'high' AS kept FROM entries WHERE {TUPLE} >= (1, 101, 7)
UNION ALL SELECT {IDS}, 'low' AS kept FROM entries WHERE {TUPLE} <= (1, 101, 7)""",
    ),
    "shard_split": Query(
        _shard_split,
        fx.sql(
            "entries",
            f"""SELECT doc_id, {IDS}, category, CASE WHEN n >= {THRESHOLD} AND {UNIT_KEY} < (me, ml)
THEN shard_id + 4 ELSE shard_id END AS partition_id, CASE WHEN n >= {THRESHOLD} THEN 3 ELSE 2 END AS depth
FROM entries JOIN medians USING (category, shard_id)""",
            MEDIANS,
        ),
    ),
    "shard_until_fits": Query(
        _until_fits,
        _until_fits_sql(
            "SELECT category, partition_id, depth, epoch_id, leader_id, num_entries FROM rounds WHERE round = 15"
        ),
    ),
    "shard_until_fits_sizes": Query(
        _until_fits_sizes,
        _until_fits_sql(
            """SELECT category, partition_id, depth, CAST(sum(num_entries) AS BIGINT) AS num_entries, bool_or(stuck) AS stuck
FROM rounds WHERE round = 15 GROUP BY category, partition_id, depth"""
        ),
    ),
    "skip_list": Query(
        _skip(True),
        fx.sql("units", f"SELECT * FROM ahead WHERE {UNIT_KEY} >= (2, 101)", BROKEN, SKIP_BASE),
    ),
    "skip_list_high": Query(
        _skip(False),
        fx.sql("units", f"SELECT * FROM ahead WHERE {UNIT_KEY} < (2, 101)", BROKEN, SKIP_BASE),
    ),
    "mark_skip": Query(
        _mark_skip,
        fx.sql(
            "units",
            f"""SELECT * REPLACE (CASE WHEN {UNIT_KEY} >= (2, 101) AND epoch_id <= (
SELECT max(epoch_id) FROM ahead) THEN 'SKIP' ELSE pull_status END AS pull_status) FROM broken""",
            BROKEN,
            SKIP_BASE,
        ),
    ),
    "recount_after_split": Query(
        lambda spark, d: shards.recount_after_split(
            shards.split_keep_high(fx.replica_entries(spark, d), MEDIAN), ["replica_id"]
        ),
        fx.sql(
            "replica_entries",
            """SELECT replica_id, count(*) AS with_markers, count(*) FILTER (entry_id <> 0) AS entries FROM replica_entries
WHERE epoch_id > 1 OR (epoch_id = 1 AND leader_id >= 101) GROUP BY replica_id""",
        ),
    ),
}
