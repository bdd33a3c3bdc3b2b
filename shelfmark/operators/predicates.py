"""Filters over catalog entries. All are column expressions that reach the scan."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.ids import id_literal, id_struct
from shelfmark.functions.terms import any_term_contains, has_term
from shelfmark.schema import ID, PULL_BATCH, UNIT, Pattern, split_tokens

EPOCH_START = datetime(1970, 1, 1)
MAX_LONG = 2**63 - 1
MIN_LONG = -(2**63)
# The circular id space leaves out the two outermost longs.
LAST_ID = MAX_LONG - 1
FIRST_ID = MIN_LONG + 1


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates)


# -- clauses of a search pattern --------------------------------------------------------


def p_file_name(pattern: str) -> Column:
    """Any token of ``pattern`` occurs inside an indexed term of the file name."""
    tokens = split_tokens(pattern, fold_case=True)
    return any_of([any_term_contains(F.col("file_name"), t) for t in tokens])


def p_size(min_size: int, max_size: int) -> Column | None:
    """Inclusive size range; ``max_size = 0`` with a positive minimum is open above."""
    size = F.col("file_size")
    if min_size >= 0 and max_size > 0:
        return size.between(min_size, max_size)
    if min_size > 0 and max_size == 0:
        return size >= min_size
    return None


def p_uploaded(lo: datetime | None, hi: datetime | None) -> Column | None:
    """Inclusive upload time range; without a lower bound it starts at the epoch."""
    uploaded = F.col("uploaded")
    if lo is not None and hi is not None:
        return uploaded.between(F.lit(lo), F.lit(hi))
    if lo is not None:
        return uploaded >= F.lit(lo)
    if hi is not None:
        return uploaded.between(F.lit(EPOCH_START), F.lit(hi))
    return None


def p_language(language: str) -> Column:
    return F.col("language") == language


def p_category(category: str) -> Column:
    return F.col("category") == category


def p_description(pattern: str, fold_case: bool = False) -> Column:
    """Any token of ``pattern`` is an indexed term of the description.

    Terms are lower-cased and tokens are not, so capitalised tokens never match
    unless ``fold_case`` is set.
    """
    tokens = split_tokens(pattern, fold_case)
    return any_of([has_term(F.col("description"), t) for t in tokens])


def pattern_predicate(pattern: Pattern, fold_case: bool = False) -> Column:
    """AND of the clauses that are present, cheap ones first; no clause matches nothing."""
    clauses = [
        p_category(pattern.category) if pattern.category is not None else None,
        p_language(pattern.language) if pattern.language is not None else None,
        p_size(pattern.min_size, pattern.max_size),
        p_uploaded(pattern.min_ts, pattern.max_ts),
        p_file_name(pattern.file_name) if pattern.file_name is not None else None,
        p_description(pattern.description, fold_case) if pattern.description is not None else None,
    ]
    present = [c for c in clauses if c is not None]
    return all_of(present) if present else F.lit(False)


def match(entries: DataFrame, pattern: Pattern, fold_case: bool = False) -> DataFrame:
    return entries.filter(pattern_predicate(pattern, fold_case))


# -- ids ------------------------------------------------------------------------------


def find_id_range(df: DataFrame, lo: int, hi: int, n: int, key: str = "id") -> DataFrame:
    """Ids in ``[lo, hi]`` ascending, at most ``n``."""
    return df.filter(F.col(key).between(lo, hi)).orderBy(key).limit(n)


def find_entry_box(
    df: DataFrame,
    lo: tuple[int, int, int],
    hi: tuple[int, int, int],
    n: int,
    lexicographic: bool = False,
) -> DataFrame:
    """Entries whose id lies between ``lo`` and ``hi``, at most ``n`` in id order.

    Each component has its own range; ``lexicographic`` compares whole ids instead.
    """
    if lexicographic:
        inside = id_struct().between(id_literal(*lo), id_literal(*hi))
        # Implied by the comparison above, and usable for pruning at the scan.
        inside = inside & F.col("epoch_id").between(lo[0], hi[0])
    else:
        inside = all_of([F.col(c).between(a, b) for c, a, b in zip(ID, lo, hi)])
    return df.filter(inside).orderBy(*ID).limit(n)


def find_entry_box_from(df: DataFrame, lo: tuple[int, int, int], n: int) -> DataFrame:
    """The same box without upper bounds."""
    return df.filter(all_of([F.col(c) >= a for c, a in zip(ID, lo)])).orderBy(*ID).limit(n)


def find_entry(df: DataFrame, entry: tuple[int, int, int]) -> DataFrame:
    """Point lookup, at most one row."""
    return df.filter(all_of([F.col(c) == v for c, v in zip(ID, entry)])).limit(1)


def in_unit(df: DataFrame, epoch_id: int, leader_id: int) -> DataFrame:
    return df.filter((F.col("epoch_id") == epoch_id) & (F.col("leader_id") == leader_id))


def unit_suffix(df: DataFrame, start: tuple[int, int, int], n: int = PULL_BATCH) -> DataFrame:
    """Entries of one unit from ``start`` on, in any order, at most ``n``."""
    return in_unit(df, start[0], start[1]).filter(F.col("entry_id") >= start[2]).limit(n)


def unit_suffix_sorted(
    df: DataFrame, start: tuple[int, int, int], n: int = PULL_BATCH
) -> DataFrame:
    """Entries of one unit from ``start`` on, the first ``n`` in id order."""
    rows = in_unit(df, start[0], start[1]).filter(F.col("entry_id") >= start[2])
    return rows.orderBy(*ID).limit(n)


def trim_high(df: DataFrame, bound: tuple[int, int, int], including: bool = False) -> DataFrame:
    """Drop ids above ``bound`` (and the bound itself if ``including``)."""
    limit = id_literal(*bound)
    return df.filter(id_struct() < limit if including else id_struct() <= limit)


def trim_low(df: DataFrame, bound: tuple[int, int, int], including: bool = False) -> DataFrame:
    """Drop ids below ``bound`` (and the bound itself if ``including``)."""
    limit = id_literal(*bound)
    return df.filter(id_struct() > limit if including else id_struct() >= limit)


def _survivors(df: DataFrame, doomed: Column) -> DataFrame:
    return df.filter(~F.coalesce(doomed, F.lit(False)))


def delete_where(df: DataFrame, *predicates: Column) -> DataFrame:
    """Rows that satisfy none of the predicates."""
    return _survivors(df, any_of([F.coalesce(p, F.lit(False)) for p in predicates]))


def delete_low_wrap(df: DataFrame, bound: int, bottom: int, top: int, key: str = "id") -> DataFrame:
    """Delete ids from ``bottom`` up to ``bound`` on a circular id space.

    The live range runs from ``bottom`` to ``top`` and may wrap past the largest id.
    """
    ids = F.col(key)
    if bottom < top or bound >= bottom:
        doomed = ids.between(bottom, bound)
    else:
        doomed = ids.between(bottom, LAST_ID) | ids.between(FIRST_ID, bound)
    return _survivors(df, doomed)


def delete_high_wrap(df: DataFrame, bound: int, bottom: int, top: int, key: str = "id") -> DataFrame:
    """Delete ids after ``bound`` up to ``top`` on a circular id space."""
    ids = F.col(key)
    if bottom < top or bound < top:
        doomed = ids.between(bound + 1, top)
    else:
        doomed = ids.between(bound + 1, LAST_ID) | ids.between(FIRST_ID, top)
    return _survivors(df, doomed)


def limit_by_unit_size(df: DataFrame, units: DataFrame) -> DataFrame:
    """Keep rows whose entry id is below the size of their unit."""
    sizes = units.filter(F.col("num_entries") > 0).select(*UNIT, "num_entries")
    return (
        df.join(sizes, UNIT)
        .filter(F.col("entry_id") < F.col("num_entries"))
        .drop("num_entries")
    )


# -- projections ------------------------------------------------------------------------


def entry_hashes(df: DataFrame) -> DataFrame:
    """(id, leader key, hash), the unit of replica comparison."""
    leader_key = F.col("leader_key") if "leader_key" in df.columns else F.lit("")
    return df.select(*ID, leader_key.alias("leader_key"), "hash")


def node_state(peers: DataFrame) -> DataFrame:
    """Peer rows as telemetry rows; the leader may be unknown."""
    leader = F.col("leader_id") if "leader_id" in peers.columns else F.lit(None)
    return peers.select(
        "node_id", "partition_id", "depth", leader.cast("bigint").alias("leader_id"), "num_entries"
    )


# -- sorts ------------------------------------------------------------------------------


def sort_entries(df: DataFrame) -> DataFrame:
    return df.orderBy(*ID)


def sort_units(df: DataFrame) -> DataFrame:
    return df.orderBy(*UNIT, "num_entries")


def sort_hits(df: DataFrame) -> DataFrame:
    return df.orderBy("score", *ID)


def topn_sorted(df: DataFrame, by: str, n: int, *tie_break: str) -> DataFrame:
    """The first ``n`` rows by a field. Ties are broken by ``tie_break``."""
    return df.orderBy(by, *tie_break).limit(n)
