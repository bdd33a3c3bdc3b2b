"""Entry ids and the timeline of leader units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.ids import unit_literal
from shelfmark.operators.ordering import following, positions
from shelfmark.schema import CONTAINER_SIZE, SHARD, UNIT, UNITS_PER_PULL


# -- ids --------------------------------------------------------------------------------


def assign_entry_ids(
    df: DataFrame,
    order_by: Sequence[str],
    shard: Sequence[str] = tuple(SHARD),
    base_epoch: int = 0,
    container: int = CONTAINER_SIZE,
) -> DataFrame:
    """Give the rows of each shard consecutive ids in arrival order.

    After ``container`` rows the next epoch starts at entry 0. ``order_by`` must be a
    total order inside a shard.
    """
    numbered = positions(df, shard, [F.col(c) for c in order_by], "_position")
    return numbered.withColumns(
        {
            "epoch_id": F.floor(F.col("_position") / container) + F.lit(base_epoch),
            "entry_id": F.col("_position") % container,
        }
    ).drop("_position")


def _distinct_ids(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    return df.select(*groups, "entry_id").distinct()


def lowest_missing(df: DataFrame, groups: Sequence[str] = tuple(UNIT)) -> DataFrame:
    """Per group the smallest entry id from 0 up that is not there.

    It is 0 or the successor of some id, so one anti-join on the id finds it: no
    group is ever sorted.
    """
    ids = _distinct_ids(df, groups)
    zero = ids.select(*groups).distinct().withColumn("entry_id", F.lit(0).cast("bigint"))
    candidates = ids.select(*groups, (F.col("entry_id") + 1).alias("entry_id")).union(zero)
    missing = candidates.join(ids, [*groups, "entry_id"], "left_anti")
    return missing.groupBy(*groups).agg(
        F.min(F.when(F.col("entry_id") >= 0, F.col("entry_id"))).alias("lowest_missing")
    )


def contiguous_prefix(df: DataFrame, groups: Sequence[str] = tuple(UNIT)) -> DataFrame:
    """Per group the lowest missing id and how many ids are stranded above it."""
    counted = _distinct_ids(df, groups).filter(F.col("entry_id") >= 0).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("ids")
    )
    return lowest_missing(df, groups).join(counted, [*groups]).select(
        *groups, "lowest_missing", (F.col("ids") - F.col("lowest_missing")).alias("stranded")
    )


def stranded_ids(df: DataFrame, groups: Sequence[str] = tuple(UNIT)) -> DataFrame:
    """The rows above the first gap of their group."""
    low = lowest_missing(df, groups)
    above = F.col("entry_id") > F.col("lowest_missing")
    return df.join(low, [*groups]).filter(above).drop("lowest_missing")


def gap_report(df: DataFrame, groups: Sequence[str] = tuple(UNIT)) -> DataFrame:
    """Every range of missing ids below the highest id of its group, both ends included."""
    ids = _distinct_ids(df, groups).filter(F.col("entry_id") >= 0)
    # An id of -1 stands before the first one, so a gap at the start is found too.
    start = ids.select(*groups).distinct().withColumn("entry_id", F.lit(-1).cast("bigint"))
    paired = following(ids.union(start), groups, "entry_id", F.col("entry_id"), "_next")
    gaps = paired.filter(F.col("_next") > F.col("entry_id") + 1)
    return gaps.select(
        *groups,
        (F.col("entry_id") + 1).alias("gap_from"),
        (F.col("_next") - 1).alias("gap_to"),
    )


# -- timeline ---------------------------------------------------------------------------


def _epoch_ends(units: DataFrame) -> DataFrame:
    """Epochs whose successor is not there: the ends of runs of consecutive epochs."""
    epochs = units.select("epoch_id").distinct()
    before = epochs.select((F.col("epoch_id") - 1).alias("epoch_id"))
    return epochs.join(before, "epoch_id", "left_anti")


def first_unit(units: DataFrame) -> DataFrame:
    """The first unit of epoch 0, if there is one."""
    start = units.filter(F.col("epoch_id") == 0)
    found = start.agg(F.min(F.struct(*UNIT, "num_entries")).alias("u"))
    return found.select("u.*").filter("epoch_id IS NOT NULL")


def next_unit(units: DataFrame) -> DataFrame:
    """The successor of every unit: next in its epoch, else the first of the next epoch.

    A missing epoch is not jumped over.
    """
    in_epoch = following(units, ["epoch_id"], "leader_id", F.col("leader_id"), "_same")
    firsts = units.groupBy((F.col("epoch_id") - 1).alias("epoch_id")).agg(
        F.min("leader_id").alias("_first")
    )
    joined = in_epoch.join(firsts, "epoch_id", "left")
    has_same = F.col("_same").isNotNull()
    return joined.withColumns(
        {
            "next_epoch": F.when(has_same, F.col("epoch_id")).when(
                F.col("_first").isNotNull(), F.col("epoch_id") + 1
            ),
            "next_leader": F.coalesce("_same", "_first"),
        }
    ).drop("_same", "_first")


def next_pending_unit(units: DataFrame) -> DataFrame:
    """The next unit that is PENDING, reached without passing a missing epoch."""
    pending = F.col("pull_status") == "PENDING"
    in_epoch = following(
        units, ["epoch_id"], "leader_id", F.when(pending, F.col("leader_id")), "_same"
    )
    # Per epoch: the first pending unit of a later epoch, and the end of the run of epochs.
    epochs = units.groupBy("epoch_id").agg(
        F.min(F.when(pending, F.col("leader_id"))).alias("_pending")
    )
    epochs = epochs.withColumn("_all", F.lit(0))
    heads = F.when(F.col("_pending").isNotNull(), F.struct("epoch_id", "_pending"))
    epochs = following(epochs, ["_all"], "epoch_id", heads, "_later")
    ends = _epoch_ends(units).withColumn("_is_end", F.lit(True))
    epochs = epochs.join(ends, "epoch_id", "left")
    epochs = following(
        epochs, ["_all"], "epoch_id", F.when(F.col("_is_end"), F.col("epoch_id")), "_end_after"
    )
    run_end = F.when(F.col("_is_end"), F.col("epoch_id")).otherwise(F.col("_end_after"))
    reachable = F.col("_later.epoch_id") <= run_end
    epochs = epochs.select("epoch_id", F.when(reachable, F.col("_later")).alias("_later"))
    joined = in_epoch.join(epochs, "epoch_id")
    has_same = F.col("_same").isNotNull()
    return joined.withColumns(
        {
            "next_epoch": F.when(has_same, F.col("epoch_id")).otherwise(F.col("_later.epoch_id")),
            "next_leader": F.coalesce("_same", "_later._pending"),
        }
    ).drop("_same", "_later")


def units_after(units: DataFrame, base: tuple[int, int]) -> DataFrame:
    """Units after ``base`` up to the first missing epoch."""
    last = (
        _epoch_ends(units).filter(F.col("epoch_id") >= base[0]).agg(F.min("epoch_id")).scalar()
    )
    after = F.struct(*UNIT) > unit_literal(*base)
    return units.filter(after & (F.col("epoch_id") >= base[0]) & (F.col("epoch_id") <= last))


def next_units(units: DataFrame, base: tuple[int, int], k: int = UNITS_PER_PULL) -> DataFrame:
    """The next ``k`` units after ``base``, to be pulled anew."""
    ahead = units_after(units, base).withColumn("pull_status", F.lit("PENDING"))
    return ahead.orderBy(*UNIT, "num_entries").limit(k)


def timeline_safe_prefix(units: DataFrame) -> DataFrame:
    """Mark the units that can be added in order; the rest stays buffered.

    The first unit must be of epoch 0, and each next one of the same or the next epoch.
    """
    starts = units.filter(F.col("epoch_id") == 0).agg(F.count(F.lit(1))).scalar()
    last = _epoch_ends(units).filter(F.col("epoch_id") >= 0).agg(F.min("epoch_id")).scalar()
    safe = (starts > 0) & F.col("epoch_id").between(F.lit(0), last)
    return units.withColumn("safe", F.coalesce(safe, F.lit(False)))


def unit_exists(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """For (epoch, leader) pairs: is the unit known?"""
    known = units.select(*UNIT).distinct().withColumn("_known", F.lit(True))
    return pairs.join(known, UNIT, "left").withColumn(
        "known", F.col("_known").isNotNull()
    ).drop("_known")


def tracked_unit(units: DataFrame, committed: DataFrame) -> DataFrame:
    """The unit that is being pulled now, and its next entry id.

    A unit is left behind when it is SKIP, or COMPLETED with all its entries
    committed (``committed``: epoch, leader, next_id). Tracking starts at the first
    unit of epoch 0 and stays on the last unit before a missing epoch.
    """
    safe = timeline_safe_prefix(units).filter("safe").join(committed, UNIT, "left")
    next_id = F.coalesce("next_id", F.lit(0))
    done = (F.col("pull_status") == "SKIP") | (
        (F.col("status") == "COMPLETED") & (next_id >= F.col("num_entries"))
    )
    row = F.struct(*UNIT, next_id.alias("next_id"), "num_entries", "status", "pull_status")
    found = safe.agg(
        F.min(F.when(~done, row)).alias("open"),
        F.max(row).alias("last"),
    ).select(F.coalesce("open", "last").alias("u"))
    return found.select("u.*").filter("epoch_id IS NOT NULL")


def mark_skip(units: DataFrame, skip: DataFrame) -> DataFrame:
    """Set the pull status of the listed units to SKIP."""
    listed = skip.select(*UNIT).distinct().withColumn("_skip", F.lit(True))
    status: Column = F.when(F.col("_skip"), F.lit("SKIP")).otherwise(F.col("pull_status"))
    return units.join(listed, UNIT, "left").withColumn("pull_status", status).drop("_skip")
