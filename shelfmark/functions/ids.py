"""Composite ids and small arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.schema import ID, PAGE_SIZE


def id_struct(*columns: Column | str) -> Column:
    """The id as one value; structs compare field by field."""
    return F.struct(*(columns or ID))


def id_literal(epoch_id: int, leader_id: int, entry_id: int) -> Column:
    return F.struct(
        F.lit(epoch_id).cast("bigint").alias("epoch_id"),
        F.lit(leader_id).cast("int").alias("leader_id"),
        F.lit(entry_id).cast("bigint").alias("entry_id"),
    )


def unit_literal(epoch_id: int, leader_id: int) -> Column:
    return F.struct(
        F.lit(epoch_id).cast("bigint").alias("epoch_id"),
        F.lit(leader_id).cast("int").alias("leader_id"),
    )


def id_compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1, by epoch, then leader, then entry."""
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def page_size_or_default(size: Column) -> Column:
    return F.when(size <= 0, PAGE_SIZE).otherwise(size)


def page_end(start: Column, size: Column, available: Column) -> Column:
    """End (exclusive) of a page over ``available`` hits."""
    return F.least(start + page_size_or_default(size), available)


def majority(n: Column) -> Column:
    """Half of ``n``, rounded half up."""
    return F.floor(n / F.lit(2.0) + F.lit(0.5))


def round2(x: Column) -> Column:
    """Half up to two decimals."""
    return F.floor(F.lit(100.0) * x + F.lit(0.5)) / F.lit(100.0)


def round9(x: Column) -> Column:
    """Half up to nine decimals; scores are ranked only after this."""
    return F.floor(F.lit(1e9) * x + F.lit(0.5)) / F.lit(1e9)
