"""Packed overlay ids and shard arithmetic on node ids.

Layout of an overlay id, high to low: 2 bits split type, 4 bits depth, 10 bits
partition, 16 bits category.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Split types, field limits and field masks.
NEVER, ONCE, MANY = 0, 1, 2
MAX_DEPTH, MAX_PARTITION, MAX_CATEGORY = 15, 1023, 65535
CATEGORY_MASK, PARTITION_MASK = 65535, 67043328
DEPTH_MASK, TYPE_MASK = 1006632960, -1073741824


def _int(column: Column) -> Column:
    return column.cast("int")


def split_type(depth: Column) -> Column:
    """Type of a shard that has been split ``depth`` times."""
    return F.when(depth == 0, NEVER).when(depth == 1, ONCE).otherwise(MANY)


def overlay_encode(
    kind: Column, depth: Column, partition: Column, category: Column, strict: bool = False
) -> Column:
    """Pack the four fields. Out-of-range fields give null, or an error if ``strict``."""
    valid = (
        depth.between(0, MAX_DEPTH)
        & partition.between(0, MAX_PARTITION)
        & category.between(0, MAX_CATEGORY)
    )
    packed = (
        F.shiftleft(_int(kind), 30)
        .bitwiseOR(F.shiftleft(_int(depth), 26))
        .bitwiseOR(F.shiftleft(_int(partition), 16))
        .bitwiseOR(_int(category))
    )
    bad = F.raise_error(F.lit("overlay field out of range")).cast("int") if strict else F.lit(None)
    return F.when(valid, packed).otherwise(bad)


def overlay_category(overlay: Column) -> Column:
    return overlay.bitwiseAND(F.lit(CATEGORY_MASK))


def overlay_partition(overlay: Column) -> Column:
    return F.shiftrightunsigned(overlay.bitwiseAND(F.lit(PARTITION_MASK)), 16)


def overlay_depth(overlay: Column) -> Column:
    return F.shiftrightunsigned(overlay.bitwiseAND(F.lit(DEPTH_MASK)), 26)


def overlay_type(overlay: Column) -> Column:
    return F.shiftrightunsigned(overlay.bitwiseAND(F.lit(TYPE_MASK)), 30)


def _power(depth: Column) -> Column:
    """2 to the depth, as a bigint; depth is at most 15."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), _int(depth))


def shard_of_node(node_id: Column, depth: Column) -> Column:
    """The low ``depth`` bits of the node id."""
    return node_id.cast("bigint").bitwiseAND(_power(depth) - 1)


def split_side(node_id: Column, depth: Column) -> Column:
    """The half a node joins at the next split."""
    return F.call_function("shiftright", node_id.cast("bigint"), _int(depth)).bitwiseAND(
        F.lit(1).cast("bigint")
    )


def sibling_partition(partition: Column, depth: Column) -> Column:
    """The other half at this depth; 0 before the first split."""
    flipped = partition.cast("bigint").bitwiseXOR(_power(depth - 1))
    return F.when(depth == 0, F.lit(0).cast("bigint")).otherwise(flipped)


def parent_partition(partition: Column, depth: Column) -> Column:
    """The shard before its last split: the low ``depth - 1`` bits."""
    mask = _power(F.greatest(depth - 1, F.lit(0))) - 1
    return partition.cast("bigint").bitwiseAND(mask)


def is_extension(received: Column, mine: Column, node_id: Column) -> Column:
    """The received overlay equals mine, or is deeper and its node falls in my shard."""
    my_depth = overlay_depth(mine)
    inside = shard_of_node(node_id, my_depth) == overlay_partition(mine)
    return (received == mine) | ((overlay_depth(received) > my_depth) & inside)


def partition_bits(partition: Column, depth: Column) -> Column:
    """The partition id as booleans, low bit first; ``[false]`` before the first split."""
    bits = F.transform(
        F.sequence(F.lit(0), F.greatest(_int(depth) - 1, F.lit(0))),
        lambda i: split_side(partition, i) == 1,
    )
    return F.when(depth == 0, F.array(F.lit(False))).otherwise(bits)
