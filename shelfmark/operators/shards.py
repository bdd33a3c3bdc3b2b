"""Splitting shards at their median."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.ids import id_literal, id_struct, unit_literal
from shelfmark.operators.ordering import select_rank, select_unit_rank
from shelfmark.operators.units import units_after
from shelfmark.schema import MAX_DEPTH, SPLIT_THRESHOLD, UNIT
from shelfmark.session import durable

Id = tuple[int, int, int]


def _below(median: Id) -> Column:
    """The unit lies below the unit of the median; its entry part does not count."""
    return F.struct(*UNIT) < unit_literal(median[0], median[1])


def split_keep_low(df: DataFrame, median: Id) -> DataFrame:
    return df.filter(_below(median))


def split_keep_high(df: DataFrame, median: Id) -> DataFrame:
    return df.filter(~_below(median))


def split_keep_low_markers(df: DataFrame, median: Id) -> DataFrame:
    """As ``split_keep_low``, but rows with entry id 0 stay."""
    return df.filter(_below(median) | (F.col("entry_id") == 0))


def split_keep_high_markers(df: DataFrame, median: Id) -> DataFrame:
    return df.filter(~_below(median) | (F.col("entry_id") == 0))


def split_buffer(buffered: DataFrame, median: Id, keep_low: bool) -> DataFrame:
    """Drop buffered ids strictly on the other side of the whole median id."""
    limit = id_literal(*median)
    return buffered.filter(id_struct() <= limit if keep_low else id_struct() >= limit)


def side_of(epoch: str = "epoch_id", leader: str = "leader_id") -> Column:
    """1 for units below ``median_epoch``/``median_leader``, else 0."""
    low = F.struct(F.col(epoch), F.col(leader)) < F.struct(
        F.col("median_epoch").alias(epoch), F.col("median_leader").alias(leader)
    )
    return F.when(low, 1).otherwise(0)


def shard_medians(df: DataFrame, shard: Sequence[str]) -> DataFrame:
    """The median id of every shard, in one job."""
    picked = select_rank(df, shard, F.floor(F.col("total") / 2))
    return picked.select(
        *shard,
        F.col("epoch_id").alias("median_epoch"),
        F.col("leader_id").alias("median_leader"),
        F.col("entry_id").alias("median_entry"),
        F.col("total").alias("shard_rows"),
    )


def _move(rows: DataFrame, due: Column) -> DataFrame:
    """New partition and depth: the side becomes the next higher bit."""
    side = F.call_function("shiftleft", side_of().cast("bigint"), F.col("depth").cast("int"))
    return rows.withColumns(
        {
            "partition_id": F.when(due, F.col("partition_id") + side).otherwise(
                F.col("partition_id")
            ),
            "depth": F.when(due, F.col("depth") + 1).otherwise(F.col("depth")),
        }
    )


def shard_split(df: DataFrame, threshold: int = SPLIT_THRESHOLD) -> DataFrame:
    """One split round over all due shards. Shards are (category, partition_id, depth).

    The low half goes to side 1 and the high half to side 0, by whole units.
    """
    shard = ["category", "partition_id", "depth"]
    medians = shard_medians(df, shard).filter(F.col("shard_rows") >= threshold)
    marked = df.join(medians, shard, "left")
    moved = _move(marked, F.col("median_epoch").isNotNull())
    return moved.drop("median_epoch", "median_leader", "median_entry", "shard_rows")


def shard_until_fits(
    df: DataFrame, threshold: int = SPLIT_THRESHOLD, max_depth: int = MAX_DEPTH
) -> tuple[DataFrame, DataFrame]:
    """Split until every shard is below ``threshold`` or ``max_depth`` deep.

    Returns the placement of units, (category, partition_id, depth, unit,
    num_entries), and the shards that cannot be split because the first of their
    units holds the median. A split moves whole units, so the rounds work on unit
    counts; the entries are read once, and once more by whoever joins the placement.
    """
    shard = ["category", "partition_id", "depth"]
    keys = [*shard, *UNIT]
    units = durable(
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("num_entries"))
        .withColumn("stuck", F.lit(False))
    )
    for _ in range(max_depth):
        sizes = units.groupBy(*shard).agg(
            F.sum("num_entries").alias("_size"),
            F.min(F.struct(*UNIT)).alias("_first"),
            F.bool_or("stuck").alias("_stuck"),
        )
        due = sizes.filter(
            (F.col("_size") >= threshold) & (F.col("depth") < max_depth) & ~F.col("_stuck")
        ).select(*shard, "_first")
        wanted = units.join(due.select(*shard), shard, "left_semi")
        picked = select_unit_rank(wanted, shard, F.floor(F.col("total") / 2), "num_entries")
        medians = durable(
            picked.join(due, shard).select(
                *shard,
                F.col("epoch_id").alias("median_epoch"),
                F.col("leader_id").alias("median_leader"),
                (F.struct("epoch_id", "leader_id") == F.col("_first")).alias("_unsplittable"),
            )
        )
        if medians.isEmpty():
            break
        marked = units.join(medians, shard, "left")
        unsplittable = F.coalesce("_unsplittable", F.lit(False))
        moved = _move(marked, F.col("median_epoch").isNotNull() & ~unsplittable)
        units = durable(
            moved.withColumn("stuck", F.col("stuck") | unsplittable).select(
                *keys, "num_entries", "stuck"
            )
        )
    placement = units.drop("stuck")
    stuck = (
        units.filter("stuck").groupBy(*shard).agg(F.sum("num_entries").alias("num_entries"))
    )
    return placement, stuck


def skip_list(
    units: DataFrame, tracked: tuple[int, int], median: Id, keep_low: bool
) -> DataFrame:
    """Units from the tracked one on that a split made irrelevant."""
    own = units.filter(
        (F.col("epoch_id") == tracked[0]) & (F.col("leader_id") == tracked[1])
    )
    ahead = own.unionByName(units_after(units, tracked))
    return ahead.filter(~_below(median) if keep_low else _below(median))


def recount_after_split(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Entries with markers, and entries without, per node after a split."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("with_markers"),
        F.count_if(F.col("entry_id") != 0).alias("entries"),
    )
