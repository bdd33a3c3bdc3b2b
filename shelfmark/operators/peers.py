"""Ranking, routing samples and neighbour tests over peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.overlay import is_extension, overlay_encode, split_type
from shelfmark.operators.ordering import following, positions
from shelfmark.schema import ROUTING_ENTRIES, SEARCH_FANOUT

BUCKET = ["category_id", "partition_id"]


def utility_order() -> list[Column]:
    """Best first: group member, deeper, more entries, smaller node id."""
    return [F.desc("is_lg_member"), F.desc("depth"), F.desc("num_entries"), F.asc("node_id")]


def natural_order() -> list[Column]:
    """Ascending: member flag, category, depth, partition, entries, then larger node id first."""
    names = ["is_lg_member", "category_id", "depth", "partition_id", "num_entries"]
    return [*(F.asc(c) for c in names), F.desc("node_id")]


def _inverted_natural() -> list[Column]:
    names = ["is_lg_member", "category_id", "depth", "partition_id", "num_entries"]
    return [*(F.desc(c) for c in names), F.asc("node_id")]


def sort_peers_natural(peers: DataFrame) -> DataFrame:
    return peers.orderBy(*natural_order())


def with_overlay(peers: DataFrame) -> DataFrame:
    """Add the packed overlay id of each peer."""
    packed = overlay_encode(
        split_type(F.col("depth")), F.col("depth"), F.col("partition_id"), F.col("category_id")
    )
    return peers.withColumn("overlay_id", packed)


def rank_peers(peers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The 1-based utility rank of every peer in its shard."""
    ranked = positions(peers, by or BUCKET, utility_order(), "rank")
    return ranked.withColumn("rank", F.col("rank") + 1)


def peers_above_k(peers: DataFrame, node_id: int, k: int) -> DataFrame:
    """The ``k`` best peers ranked at or above the given one, best first."""
    # A struct that grows with utility, so "at or above" is one comparison.
    key = F.struct(
        F.col("is_lg_member").cast("int").alias("m"),
        F.col("depth").alias("d"),
        F.col("num_entries").alias("e"),
        (-F.col("node_id")).alias("n"),
    )
    own = peers.filter(F.col("node_id") == node_id).agg(F.max(key)).scalar()
    return peers.filter(key >= own).orderBy(*utility_order()).limit(k)


def best_node_cohort(
    peers: DataFrame,
    size: int,
    by: list[str] | None = None,
    ignore_membership: bool = False,
    candidate: int | None = None,
) -> DataFrame:
    """Per shard the candidate and its best ``size`` companions that are not behind a NAT.

    The candidate is the best node, or the given one. A shard yields nothing when
    its candidate is behind a NAT or a better node is in view.
    """
    by = by or BUCKET
    view = peers.withColumn("is_lg_member", F.lit(False)) if ignore_membership else peers
    utility = F.struct("is_lg_member", "depth", "num_entries", (-F.col("node_id")).alias("_n"))
    best = view.groupBy(*by).agg(F.max_by(F.struct("node_id", "is_nated"), utility).alias("_best"))
    eligible = ~F.col("_best.is_nated")
    if candidate is not None:
        eligible = eligible & (F.col("_best.node_id") == candidate)
    best = best.filter(eligible).select(*by, F.col("_best.node_id").alias("best_id"))
    order = Window.partitionBy(*by).orderBy(*utility_order())
    # One more than needed, because the candidate itself may be among them.
    top = (
        view.filter(~F.col("is_nated"))
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= size + 1)
    )
    others = top.join(best, by).filter(F.col("node_id") != F.col("best_id"))
    again = Window.partitionBy(*by).orderBy("_r")
    return (
        others.withColumn("place", F.row_number().over(again))
        .filter(F.col("place") <= size)
        .select(*by, "best_id", "place", "node_id")
    )


def freshest_peers(samples: DataFrame, limit: int = ROUTING_ENTRIES) -> DataFrame:
    """The routing table: per bucket the ``limit`` youngest peers of the deepest depth.

    Of several samples of a peer the deepest counts, then the youngest.
    """
    rest = [c for c in samples.columns if c not in (*BUCKET, "node_id")]
    freshness = F.struct(F.col("depth"), (-F.col("age")).alias("_young"), "num_entries")
    single = (
        samples.groupBy(*BUCKET, "node_id")
        .agg(F.max_by(F.struct(*rest), freshness).alias("_s"))
        .select(*BUCKET, "node_id", "_s.*")
    )
    order = Window.partitionBy(*BUCKET).orderBy(
        F.desc("depth"), F.asc("age"), *_inverted_natural()
    )
    kept = single.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    deepest = F.max("depth").over(Window.partitionBy(*BUCKET))
    return kept.withColumn("_deepest", deepest).filter("depth = _deepest").drop("_deepest")


def search_targets(peers: DataFrame, fanout: int = SEARCH_FANOUT) -> DataFrame:
    """Per shard the ``fanout`` youngest peers."""
    order = Window.partitionBy(*BUCKET).orderBy(F.asc("age"), *_inverted_natural())
    return peers.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= fanout)


def unverified_peers(
    peers: DataFrame, verified: DataFrame, mine: Column
) -> DataFrame:
    """Peers whose last unit is not verified although their overlay passes the extension test.

    ``mine`` is the own overlay id. The test is called with (mine, theirs), so it
    holds for the same shard or when the own shard is the deeper one.
    """
    suspects = with_overlay(peers).filter(
        F.col("last_epoch").isNotNull() & is_extension(mine, F.col("overlay_id"), F.col("node_id"))
    )
    known = verified.select(
        F.col("epoch_id").alias("last_epoch"), F.col("leader_id").alias("last_leader")
    )
    return suspects.join(known, ["last_epoch", "last_leader"], "left_anti")


def neighbour_test() -> Column:
    """Keep the other peer: same category, not shallower, and inside the own shard."""
    return (
        (F.col("self.category_id") == F.col("other.category_id"))
        & (F.col("self.depth") <= F.col("other.depth"))
        & is_extension(
            F.col("other.overlay_id"), F.col("self.overlay_id"), F.col("other.node_id")
        )
    )


def peer_neighbours(
    views: DataFrame, peers: DataFrame, keep: Column | None = None
) -> DataFrame:
    """Filter the views peers have of each other.

    ``views`` has one row per (self_id, other_id) that met; only those pairs are
    tested, so the work grows with the views and never with the square of a shard.
    ``keep`` replaces the standard test; it may use ``self.*`` and ``other.*``.
    """
    known = with_overlay(peers)
    mine = known.select("node_id", F.struct(*known.columns).alias("self"))
    theirs = known.select("node_id", F.struct(*known.columns).alias("other"))
    paired = (
        views.select("self_id", "other_id")
        .distinct()
        .filter(F.col("self_id") != F.col("other_id"))
        .join(mine.withColumnRenamed("node_id", "self_id"), "self_id")
        .join(theirs.withColumnRenamed("node_id", "other_id"), "other_id")
    )
    return paired.filter(neighbour_test() if keep is None else keep).select("self_id", "other_id")


def ring_assign(keys: DataFrame, nodes: DataFrame, key: str, node: str) -> DataFrame:
    """Give each key the first node id at or after it, else the smallest node id.

    Distinct keys and nodes meet in blocks of the id space; a key without a node in
    its block takes the first node of a later block.
    """
    ids = keys.select(F.col(key).alias("_id"), F.lit(False).alias("_node")).union(
        nodes.select(F.col(node).alias("_id"), F.lit(True).alias("_node"))
    )
    ids = ids.groupBy("_id").agg(F.bool_or("_node").alias("_node"))
    ids = ids.withColumn("_all", F.lit(0))
    placed = following(ids, ["_all"], "_id", F.when(F.col("_node"), F.col("_id")), "_next")
    smallest = nodes.agg(F.min(node)).scalar()
    owner = F.when(F.col("_node"), F.col("_id")).otherwise(F.coalesce("_next", smallest))
    owners = placed.select(F.col("_id").alias(key), owner.alias("owner"))
    return keys.join(owners, key)
