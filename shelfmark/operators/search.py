"""Paginated search: match, score, best hits per shard, merge, page, fetch.

Hits carry ids and scores only. Whole rows are read for one page at the end.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.ids import round9
from shelfmark.functions.terms import any_term_contains, has_term, term_count, terms
from shelfmark.operators.predicates import match
from shelfmark.schema import HIT_LIST_SECONDS, ID, PAGE_SIZE, SHARD, Pattern
from shelfmark.sources import generations


# -- score ----------------------------------------------------------------------------


def file_name_score(tokens: Sequence[str]) -> Column:
    """m * m / T for m of T tokens found."""
    found = [any_term_contains(F.col("file_name"), t).cast("int") for t in tokens]
    m = sum(found[1:], found[0])
    return F.pow(m, F.lit(2.0)) / F.lit(float(len(tokens)))


def idf(documents: int, df: int) -> float:
    return 1.0 + math.log(documents / (df + 1))


def description_weights(entries: DataFrame, tokens: Sequence[str]) -> dict[str, float]:
    """Squared idf per token, from one aggregation over the catalog."""
    distinct = sorted(set(tokens))
    counts = entries.agg(
        F.count(F.lit(1)), *(F.count_if(has_term(F.col("description"), t)) for t in distinct)
    )
    n, *dfs = counts.first()
    return {t: idf(n, df) ** 2 if n else 0.0 for t, df in zip(distinct, dfs)}


def description_score(tokens: Sequence[str], weights: dict[str, float]) -> Column:
    """Sum of sqrt(tf) * idf^2 / sqrt(length) over the tokens."""
    text = F.col("description")
    # An empty text has no hit, so the floor of 1 only avoids a division by zero.
    norm = F.sqrt(F.greatest(F.size(terms(text)), F.lit(1)).cast("double"))
    parts = [F.sqrt(term_count(text, t).cast("double")) * F.lit(weights[t]) / norm for t in tokens]
    return sum(parts[1:], parts[0])


def score(entries: DataFrame, pattern: Pattern, fold_case: bool = False) -> DataFrame:
    """Matching entries as hits: shard, id and score.

    Only token clauses score. Catalog statistics are read only if the pattern has
    description tokens.
    """
    value = F.lit(0.0)
    if tokens := pattern.file_tokens():
        value = value + file_name_score(tokens)
    if tokens := pattern.description_tokens(fold_case):
        value = value + description_score(tokens, description_weights(entries, tokens))
    return match(entries, pattern, fold_case).select(*SHARD, *ID, round9(value).alias("score"))


# -- query phase ----------------------------------------------------------------------


def shard_topk(hits: DataFrame, k: int, by: Sequence[str] = tuple(SHARD)) -> DataFrame:
    """The best ``k`` hits of each shard. The limit is applied before and after the shuffle."""
    best = Window.partitionBy(*by).orderBy(F.desc("score"), *ID)
    return hits.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r")


def shard_topk_entries(entries: DataFrame, pattern: Pattern, k: int) -> DataFrame:
    """The same as whole entries. Rows are read after the limit, not carried through it."""
    return fetch_entries(entries, shard_topk(score(entries, pattern), k))


def dedup(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def first_reply(
    replies: DataFrame,
    round_col: str = "round_id",
    shard_col: str = "shard_id",
    ts_col: str = "ts",
    expected: DataFrame | None = None,
) -> DataFrame:
    """The first reply of every shard in a round.

    A minimum combines before the shuffle, so many replies of one round cost little.
    With ``expected`` (round_id, expected) a round takes the earliest replies of as many
    shards as were asked, and none if it asked nobody.
    """
    rest = [c for c in replies.columns if c not in (round_col, shard_col, ts_col)]
    firsts = replies.groupBy(round_col, shard_col).agg(F.min(F.struct(ts_col, *rest)).alias("_f"))
    firsts = firsts.select(round_col, shard_col, "_f.*")
    if expected is None:
        return firsts
    # One row per shard of a round is left, so this order is over shards, not replies.
    order = Window.partitionBy(round_col).orderBy(ts_col, shard_col)
    ranked = firsts.withColumn("_r", F.row_number().over(order))
    asked = expected.select(F.col("round_id").alias(round_col), F.col("expected").alias("_asked"))
    return ranked.join(asked, round_col).filter(F.col("_r") <= F.col("_asked")).drop("_r", "_asked")


def round_complete(replies: DataFrame, expected: DataFrame) -> DataFrame:
    """Per round: have as many shards replied as were asked?

    ``expected`` has the columns round_id and expected. A round that asked nobody
    is never complete.
    """
    got = replies.groupBy("round_id").agg(F.count_distinct("shard_id").alias("replied"))
    replied = F.coalesce("replied", F.lit(0))
    return expected.join(got, "round_id", "left").select(
        "round_id",
        "expected",
        replied.alias("replied"),
        ((F.col("expected") != 0) & (replied >= F.col("expected"))).alias("complete"),
    )


def hit_order(best_first: bool = False) -> list[Column]:
    return [F.desc("score") if best_first else F.asc("score"), *(F.asc(c) for c in ID)]


def merge_hits(hits: DataFrame, cap: int | None = None, best_first: bool = False) -> DataFrame:
    """All shards in one order; with ``cap`` the first so many.

    The order is weakest first, as in the service this serves; ``best_first`` turns it round.
    """
    ordered = hits.orderBy(*hit_order(best_first))
    return ordered if cap is None else ordered.limit(cap)


def num_hits(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count(F.lit(1)).alias("hits"))


def page(
    merged: DataFrame, from_: int = 0, size: int = PAGE_SIZE, best_first: bool = False
) -> DataFrame:
    """One page of merged hits; past the end it is empty."""
    return (
        merged.orderBy(*hit_order(best_first)).offset(from_).limit(size if size > 0 else PAGE_SIZE)
    )


def retain(hits: DataFrame, page_hits: DataFrame) -> DataFrame:
    """Per shard the hits that are on the page: same id and same score."""
    return hits.join(page_hits.select(*ID, "score"), [*ID, "score"], "left_semi")


# -- fetch phase ----------------------------------------------------------------------


def fetch_entries(entries: DataFrame, page_hits: DataFrame) -> DataFrame:
    """Whole rows of a page with their scores; ids that are not stored drop out.

    A page has a limit, so the planner knows that it is small.
    """
    return entries.join(page_hits.select(*ID, "score"), ID)


def fetch_ids(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select(*ID).distinct(), ID)


def final_order(fetched: DataFrame, best_first: bool = False) -> DataFrame:
    return fetched.orderBy(*hit_order(best_first)).drop("score")


# -- the whole search -------------------------------------------------------------------


def merged_hits(
    entries: DataFrame,
    pattern: Pattern,
    k: int | None = None,
    cap: int | None = None,
    best_first: bool = False,
    fold_case: bool = False,
) -> DataFrame:
    """All hits in order; ``k`` keeps the best of each shard only, ``cap`` the first of all."""
    hits = score(entries, pattern, fold_case)
    return merge_hits(hits if k is None else shard_topk(hits, k), cap, best_first)


def search(
    entries: DataFrame,
    pattern: Pattern,
    from_: int = 0,
    size: int = PAGE_SIZE,
    k: int | None = None,
    best_first: bool = False,
    fold_case: bool = False,
    mode: str = "topk",
) -> DataFrame:
    """One page of results as whole entries, out of all hits (``k``: the best of each shard).

    ``mode='count'`` collects only the number of matches and reads no rows.
    """
    if mode == "count":
        return match(entries, pattern, fold_case).agg(F.count(F.lit(1)).alias("hits"))
    merged = merged_hits(entries, pattern, k, best_first=best_first, fold_case=fold_case)
    return final_order(fetch_entries(entries, page(merged, from_, size, best_first)), best_first)


def search_union(
    entries: DataFrame, pattern: Pattern, k: int | None = None, cap: int | None = None
) -> DataFrame:
    """The older path: union the results of all shards and search that union again.

    Statistics for the second score are those of the union, and the best come first. ``k``
    limits the results of a shard, ``cap`` the answer.
    """
    found = match(entries, pattern) if k is None else shard_topk_entries(entries, pattern, k).drop("score")
    again = score(found.dropDuplicates(ID), pattern)
    return merge_hits(again, cap, best_first=True)


# -- hit lists kept for later pages -------------------------------------------------------


def pattern_key(pattern: Pattern) -> str:
    """A stable name for equal patterns."""
    return hashlib.md5(repr(pattern).encode()).hexdigest()


def _micros(at: datetime) -> int:
    return round((at - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


LIFE = HIT_LIST_SECONDS * 1_000_000


def store_hits(hits: DataFrame, pattern: Pattern, at: datetime, path: str) -> None:
    """Keep the merged hits of a pattern, also if there are none.

    A list comes into being when it is written as a whole. Lists that are too old by then leave the
    store; their files go when they are twice as old, so that a reader can finish.
    """
    spark, now = hits.sparkSession, _micros(at)
    name, folder = generations.new_part(path, str(now))
    hits.write.parquet(folder)
    made = {"folder": name, "key": pattern_key(pattern), "at": now, "schema": hits.schema.json()}
    generations.change(
        spark, path, lambda base: [*(p for p in base.parts if p["at"] > now - LIFE), made]
    )
    generations.forget(spark, path, 2)
    for folder in generations.folder_names(spark, f"{path}/{generations.DATA}"):
        if int(folder.split("-")[1]) <= now - 2 * LIFE:
            generations.remove(spark, f"{path}/{generations.DATA}/{folder}")


def _young_list(spark: SparkSession, pattern: Pattern, now: datetime, path: str) -> dict | None:
    """The newest list of an equal pattern that is younger than 25 seconds."""
    at = _micros(now)
    lists = [
        p
        for p in generations.version(spark, path).parts
        if p["key"] == pattern_key(pattern) and at - LIFE < p["at"] <= at
    ]
    return max(lists, key=lambda p: (p["at"], p["folder"]), default=None)


def cached_hits(spark: SparkSession, pattern: Pattern, now: datetime, path: str) -> DataFrame | None:
    """The newest hit list of an equal pattern that is younger than 25 seconds; None if there is none."""
    found = _young_list(spark, pattern, now, path)
    if found is None:
        return None
    schema = T.StructType.fromJson(json.loads(found["schema"]))
    return spark.read.schema(schema).parquet(f"{path}/{generations.DATA}/{found['folder']}")


def search_cached(
    entries: DataFrame,
    pattern: Pattern,
    now: datetime,
    path: str,
    from_: int = 0,
    size: int = PAGE_SIZE,
    best_first: bool = False,
) -> DataFrame:
    """A page out of the hit list of an equal pattern, if one is young enough, else out of a
    new search, whose hit list is kept for later pages."""
    spark = entries.sparkSession
    hits = cached_hits(spark, pattern, now, path)
    if hits is None:
        store_hits(merged_hits(entries, pattern, best_first=best_first), pattern, now, path)
        hits = cached_hits(spark, pattern, now, path)
    return final_order(fetch_entries(entries, page(hits, from_, size, best_first)), best_first)
