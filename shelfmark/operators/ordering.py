"""Row numbers, order statistics and next-row lookups that never put one group into one task.

A plain ``row_number`` or ``lead`` over ``partitionBy(shard)`` sorts a whole shard in
one task. The three functions here give the same answers for shards of any size:

* ``positions`` spreads rows by range over the full sort key, numbers them locally
  and adds the size of the earlier pieces;
* ``select_rank`` finds the id at a rank from counts, narrowing block by block;
* ``following`` looks ahead inside pieces of the spread rows and falls back to the first
  value of a later piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import durable

BLOCK = 4096
# monotonically_increasing_id keeps the partition number above this bit.
_PARTITION_SHIFT = 33


def positions(
    df: DataFrame, groups: Sequence[str], order_by: Sequence[Column], name: str = "position"
) -> DataFrame:
    """Add the 0-based position of every row in its group.

    The order must be total. The spread rows are checkpointed before they are
    numbered, so a lost executor cannot change the ranges between the two uses.
    """
    keys = [*(F.col(g) for g in groups), *order_by]
    spread = durable(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    spread = spread.withColumn("_piece", F.shiftright("_row", _PARTITION_SHIFT))
    pieces = spread.groupBy(*groups, "_piece").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")
    )
    earlier = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *groups,
        "_piece",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return (
        spread.join(offsets, [*groups, "_piece"])
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .drop("_row", "_piece", "_shift")
    )


def narrow(counts: DataFrame, groups: Sequence[str], keys: Sequence[str | Column]) -> DataFrame:
    """Pick, per group, the key whose rows cover the 0-based rank ``target``.

    ``counts`` has one row per group and key with the columns ``n`` and ``target``.
    The result carries ``target`` re-based to the picked key.
    """
    names = [k for k in keys if isinstance(k, str)]
    window = (
        Window.partitionBy(*groups).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    )
    before = F.col("_upto") - F.col("n")
    return (
        counts.withColumn("_upto", F.sum("n").over(window))
        .filter((F.col("_upto") > F.col("target")) & (before <= F.col("target")))
        .select(*groups, *names, (F.col("target") - before).alias("target"))
    )


def _block(column: str) -> Column:
    return F.floor(F.col(column) / F.lit(BLOCK))


def select_unit_rank(
    units: DataFrame, groups: Sequence[str], target: Column, size: str = "n"
) -> DataFrame:
    """Per group the unit that holds the row at rank ``target`` (an expression over ``total``).

    ``units`` has one row per group and unit with its row count. Sums over blocks
    of epochs come first, so a window sees one block list or one block only.
    """
    base = units.select(
        *groups, "epoch_id", "leader_id", F.col(size).alias("n"), _block("epoch_id").alias("_eb")
    )
    blocks = base.groupBy(*groups, "_eb").agg(F.sum("n").alias("n"))
    totals = blocks.groupBy(*groups).agg(F.sum("n").alias("total"))
    wanted = totals.select(*groups, "total", target.cast("bigint").alias("target"))
    block = narrow(blocks.join(wanted, [*groups]), [*groups, "total"], ["_eb"])
    inside = base.join(block, [*groups, "_eb"])
    by_unit = inside.groupBy(*groups, "total", "epoch_id", "leader_id", "target").agg(
        F.sum("n").alias("n")
    )
    return narrow(by_unit, [*groups, "total"], ["epoch_id", "leader_id"])


def select_rank(df: DataFrame, groups: Sequence[str], target: Column) -> DataFrame:
    """Per group the composite id at rank ``target`` (an expression over ``total``).

    Counts per unit and block of entry ids are combined before the shuffle; only
    the ids of one block per group are looked at one by one.
    """
    if not groups:
        # One group: its key comes from the rows, so that joins on it stay joins on a key.
        whole = select_rank(df.withColumn("_all", F.pmod("epoch_id", F.lit(1))), ["_all"], target)
        return whole.drop("_all")
    ids = df.select(*groups, "epoch_id", "leader_id", "entry_id", _block("entry_id").alias("_nb"))
    coarse = ids.groupBy(*groups, "epoch_id", "leader_id", "_nb").agg(
        F.count(F.lit(1)).alias("n")
    )
    unit = select_unit_rank(coarse, groups, target)
    unit_keys = [*groups, "epoch_id", "leader_id"]
    carried = [*unit_keys, "total"]
    block = narrow(coarse.join(unit, unit_keys), carried, ["_nb"])
    in_block = (
        ids.join(block, [*unit_keys, "_nb"])
        .groupBy(*carried, "entry_id", "target")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return narrow(in_block, carried, ["entry_id"]).drop("target")


def following(
    df: DataFrame, groups: Sequence[str], key: str, value: Column, name: str
) -> DataFrame:
    """Add the first non-null ``value`` among later rows (by integer ``key``) of the group.

    Keys must be unique within a group. Rows are spread by range over groups and key; a
    row looks ahead inside its piece, and beyond it at the first values of later pieces, of
    which a group has no more than there are partitions.
    """
    spread = durable(
        df.withColumn("_value", value)
        .repartitionByRange(*groups, key)
        .withColumn("_piece", F.spark_partition_id())
    )
    # Backwards, so that the frame grows with the rows instead of being scanned anew for each.
    ahead = (
        Window.partitionBy(*groups, "_piece")
        .orderBy(F.desc(key))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = spread.withColumn("_inside", F.last("_value", ignorenulls=True).over(ahead))
    heads = spread.groupBy(*groups, "_piece").agg(
        F.min_by("_value", F.when(F.col("_value").isNotNull(), F.col(key))).alias("_head")
    )
    later = (
        Window.partitionBy(*groups)
        .orderBy(F.desc("_piece"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    beyond = heads.select(
        *groups, "_piece", F.last("_head", ignorenulls=True).over(later).alias("_beyond")
    )
    return (
        inside.join(beyond, [*groups, "_piece"])
        .withColumn(name, F.coalesce("_inside", "_beyond"))
        .drop("_piece", "_value", "_inside", "_beyond")
    )
