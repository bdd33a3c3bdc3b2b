"""Ranking, routing and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.overlay import overlay_encode
from shelfmark.operators import peers
from shelfmark.plans import fixtures as fx
from shelfmark.plans.registry import Query

Spark = SparkSession
BUCKET = "category_id, partition_id"
UTILITY = "is_lg_member DESC, depth DESC, num_entries DESC, node_id"
INVERTED = "is_lg_member DESC, category_id DESC, depth DESC, partition_id DESC, num_entries DESC, node_id"


def _peers(make):
    return lambda spark, d: make(fx.peers(spark, d))


def _samples(spark: Spark, d: str) -> DataFrame:
    """Aged samples of peers: one per order of a customer, some at an older depth."""
    orders = fx.table(spark, d, "orders").select(
        F.col("o_custkey").alias("node_id"),
        (F.col("o_orderkey") % 50).alias("sample_age"),
        (F.col("o_orderkey") % 3).alias("step"),
    )
    rows = fx.peers(spark, d).drop("age").join(orders, "node_id")
    entries = F.col("num_entries") + F.col("sample_age")
    return rows.select(
        "node_id",
        "category_id",
        "partition_id",
        F.greatest(F.col("depth") - F.col("step") % 2, F.lit(1)).alias("depth"),
        F.col("sample_age").alias("age"),
        entries.alias("num_entries"),
        "is_lg_member",
    )


SAMPLES = """samples AS (SELECT p.node_id, category_id, partition_id,
greatest(depth - (o_orderkey % 3) % 2, 1) AS depth, o_orderkey % 50 AS age,
num_entries + o_orderkey % 50 AS num_entries, is_lg_member FROM peers p JOIN orders o ON p.node_id = o.o_custkey)"""


def _views(spark: Spark, d: str) -> DataFrame:
    """Who met whom: a customer and the customer numbered like the order."""
    orders = fx.table(spark, d, "orders")
    size = fx.table(spark, d, "customer").agg(F.count(F.lit(1))).scalar()
    return orders.select(
        F.col("o_custkey").alias("self_id"), (F.col("o_orderkey") % size).alias("other_id")
    )


VIEWS = """views AS (SELECT DISTINCT o_custkey AS self_id, o_orderkey % (SELECT count(*) FROM customer) AS other_id FROM orders)"""


def _neighbours(spark: Spark, d: str) -> DataFrame:
    return peers.peer_neighbours(_views(spark, d), fx.peers(spark, d))


def _filtered(spark: Spark, d: str) -> DataFrame:
    """A user test instead of the standard one: a fuller peer of the same category."""
    keep = (F.col("self.category_id") == F.col("other.category_id")) & (
        F.col("other.num_entries") > F.col("self.num_entries")
    )
    return peers.peer_neighbours(_views(spark, d), fx.peers(spark, d), keep)


def _ring(spark: Spark, d: str) -> DataFrame:
    nodes = fx.table(spark, d, "supplier").select((F.col("s_suppkey") * 13 + 5).alias("server"))
    keys = fx.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    return peers.ring_assign(keys, nodes, "key", "server")


def _unverified(spark: Spark, d: str) -> DataFrame:
    known = fx.entries(spark, d).select("epoch_id", "leader_id").distinct()
    known = known.filter(F.col("epoch_id") < 6)
    mine = overlay_encode(F.lit(2), F.lit(2), F.lit(3), F.lit(1))
    found = peers.unverified_peers(fx.peers(spark, d), known, mine)
    return found.select("node_id", "last_epoch", "last_leader")


COHORT_SQL = f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {BUCKET} ORDER BY __ORDER__) AS rn FROM peers) WHERE rn = 1),
cohort AS (SELECT p.category_id, p.partition_id, b.node_id AS best_id,
row_number() OVER (PARTITION BY p.category_id, p.partition_id ORDER BY __P_ORDER__) AS place, p.node_id
FROM peers p JOIN best b USING ({BUCKET}) WHERE NOT b.is_nated AND NOT p.is_nated AND p.node_id <> b.node_id)"""


def _cohort_sql(member: bool) -> str:
    order = UTILITY if member else UTILITY.removeprefix("is_lg_member DESC, ")
    prefixed = ", ".join("p." + part for part in order.split(", "))
    cte = COHORT_SQL.replace("__P_ORDER__", prefixed).replace("__ORDER__", order)
    return fx.sql(
        "peers", "SELECT category_id, partition_id, best_id, place, node_id FROM cohort WHERE place <= 6", cte
    )


QUERIES: dict[str, Query] = {
    "rank_peers": Query(
        lambda spark, d: peers.rank_peers(fx.peers(spark, d)).select(
            "category_id", "partition_id", "node_id", "rank"
        ),
        fx.sql(
            "peers",
            f"SELECT {BUCKET}, node_id, row_number() OVER (PARTITION BY {BUCKET} ORDER BY {UTILITY}) AS rank FROM peers",
        ),
    ),
    "best_node_cohort": Query(
        _peers(lambda df: peers.best_node_cohort(df, 6)), _cohort_sql(True)
    ),
    "best_node_cohort_continue": Query(
        _peers(lambda df: peers.best_node_cohort(df, 6, ignore_membership=True)), _cohort_sql(False)
    ),
    "peers_above_k": Query(
        _peers(lambda df: peers.peers_above_k(df, 77, 10).select("node_id", "num_entries")),
        fx.sql(
            "peers",
            f"""SELECT node_id, num_entries FROM (SELECT *, row_number() OVER (ORDER BY {UTILITY}) AS rn FROM peers)
WHERE rn <= (SELECT rn FROM (SELECT node_id, row_number() OVER (ORDER BY {UTILITY}) AS rn FROM peers) WHERE node_id = 77)
ORDER BY rn LIMIT 10""",
        ),
    ),
    "freshest_peers": Query(
        lambda spark, d: peers.freshest_peers(_samples(spark, d)).select(
            "category_id", "partition_id", "node_id", "depth", "age", "place"
        ),
        fx.sql(
            "peers",
            f"""SELECT {BUCKET}, node_id, depth, age, place FROM (SELECT *, row_number() OVER (
PARTITION BY {BUCKET} ORDER BY age, {INVERTED}) AS place FROM (SELECT *, row_number() OVER (
PARTITION BY {BUCKET}, node_id ORDER BY age, num_entries DESC) AS youngest FROM (
SELECT *, max(depth) OVER (PARTITION BY {BUCKET}) AS deepest FROM samples) WHERE depth = deepest)
WHERE youngest = 1) WHERE place <= 20""",
            SAMPLES,
        ),
    ),
    "search_targets": Query(
        _peers(
            lambda df: peers.search_targets(df).select(
                "category_id", "partition_id", "node_id", "age", "place"
            )
        ),
        fx.sql(
            "peers",
            f"""SELECT {BUCKET}, node_id, age, place FROM (SELECT *, row_number() OVER (
PARTITION BY {BUCKET} ORDER BY age, {INVERTED}) AS place FROM peers) WHERE place <= 3""",
        ),
    ),
    "unverified_peers": Query(
        _unverified,
        fx.sql(
            ["peers", "entries"],
            """SELECT node_id, last_epoch, last_leader FROM peers p WHERE (
(depth = 2 AND partition_id = 3 AND category_id = 1) OR (depth < 2 AND node_id % 2 >= 0 AND 2 > depth
AND (node_id & ((1 << depth) - 1)) = partition_id))
AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.epoch_id < 6 AND e.epoch_id = p.last_epoch AND e.leader_id = p.last_leader)""",
        ),
    ),
    "peer_neighbours": Query(
        _neighbours,
        fx.sql(
            "peers",
            """SELECT self_id, other_id FROM views v JOIN peers s ON s.node_id = self_id JOIN peers o ON o.node_id = other_id
WHERE self_id <> other_id AND s.category_id = o.category_id AND s.depth <= o.depth
AND ((s.depth = o.depth AND s.partition_id = o.partition_id)
OR (o.depth > s.depth AND (other_id & ((1 << s.depth) - 1)) = s.partition_id))""",
            VIEWS,
        ),
    ),
    "peer_filter": Query(
        _filtered,
        fx.sql(
            "peers",
            """SELECT self_id, other_id FROM views v JOIN peers s ON s.node_id = self_id JOIN peers o ON o.node_id = other_id
WHERE self_id <> other_id AND s.category_id = o.category_id AND o.num_entries > s.num_entries""",
            VIEWS,
        ),
    ),
    "ring_assign": Query(
        _ring,
        """SELECT o_orderkey, o_custkey AS key, coalesce((SELECT min(s_suppkey * 13 + 5) FROM supplier WHERE s_suppkey * 13 + 5 >= o_custkey),
(SELECT min(s_suppkey * 13 + 5) FROM supplier)) AS owner FROM orders""",
    ),
}
