"""The best hits of a search from blocks of postings, without reading blocks that cannot matter.

The postings of a term stand in blocks by what they add to a score, and the index knows the
most that a posting of each block adds. The best blocks are read first, until some k entries are
known; the k-th of their scores so far is a bound that the answer cannot fall below. A block is
then read only if its best posting, with the best of all other terms, reaches the bound: an
entry of any other block scores less, whatever else it holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.ids import round9
from shelfmark.operators.batch_search import prepare_patterns, residual
from shelfmark.operators.search import fetch_entries, final_order, hit_order, idf
from shelfmark.schema import ID, PAGE_SIZE, PATTERN_SCHEMA, SHARD, Pattern
from shelfmark.session import durable
from shelfmark.sources.index import Index

#: Scores are rounded to 9 decimals, so a bound is taken lower by more than that.
SLACK = 1e-8


@dataclass(frozen=True)
class Work:
    """What a search has read: blocks and postings, of all that its terms have."""

    blocks_read: int
    blocks: int
    postings_read: int
    postings: int


def _weights(index: Index, tokens: list[str]) -> dict[str, float]:
    """Squared idf of each distinct token that occurs, times how often it is asked for."""
    spark = index.spark
    asked = spark.createDataFrame([("description", t) for t in sorted(set(tokens))], "field string, term string")
    known = [("description", t) for t in sorted(set(tokens))]
    counts = {r["term"]: r["df"] for r in index.counts_of(asked, known).collect()}
    return {t: tokens.count(t) * idf(index.documents, df) ** 2 for t, df in counts.items()}


def _scored(index: Index, blocks: list, weights: dict[str, float], checks: Column | None) -> DataFrame:
    """Scores of all entries, as far as the postings of these blocks tell."""
    rows = index.postings_of_blocks([(b["segment"], b["term"], b["level"]) for b in blocks])
    if checks is not None:
        rows = rows.filter(checks)
    pairs = sorted(weights.items()) or [("", 0.0)]
    weight = F.create_map(*(F.lit(x) for pair in pairs for x in pair))[F.col("term")]
    gain = F.sqrt(F.col("tf").cast("double")) * weight / F.sqrt(F.col("length").cast("double"))
    return rows.groupBy(*SHARD, *ID).agg(round9(F.sum(gain)).alias("score"))


def _checks(pattern: Pattern, index: Index, fold_case: bool) -> Column | None:
    """The clauses other than tokens, on the attributes that postings carry."""
    row = (0, None, pattern.min_size, pattern.max_size, pattern.min_ts, pattern.max_ts, pattern.language, pattern.category, None, 0, 0)
    prepared = prepare_patterns(index.spark.createDataFrame([row], PATTERN_SCHEMA), fold_case).first().asDict()
    return residual({name: F.lit(value) for name, value in prepared.items() if name.startswith("p_") and not isinstance(value, list)})


def best_hits(index: Index, pattern: Pattern, k: int, fold_case: bool = False) -> tuple[DataFrame, Work]:
    """The k best hits (shard, id, score) of a pattern with description tokens, in the order of
    ``hit_order(best_first=True)``, and the work it took.

    The pattern may have any other clause but file-name tokens. The index must carry the
    attributes (``batch_search.ATTRIBUTES``). Removed entries bound blocks but are never hits.
    """
    tokens = pattern.description_tokens(fold_case)
    if pattern.file_name or not tokens:
        raise ValueError("a pattern with description tokens and without a file name is needed")
    weights = _weights(index, tokens)
    # A few dozen levels for each token of one pattern, in each segment.
    blocks = sorted(
        index.blocks_of(sorted(weights)).collect(), key=lambda b: (-b["best"] * weights[b["term"]], b["term"], b["segment"])
    )
    postings = sum(b["postings"] for b in blocks)
    checks = _checks(pattern, index, fold_case)
    bound, wanted, first = 0.0, 2 * k, 0
    while first < len(blocks):
        read = 0
        first = 0
        while first < len(blocks) and read < wanted:
            read += blocks[first]["postings"]
            first += 1
        found = _scored(index, blocks[:first], weights, checks)
        least = found.orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count(F.lit(1))).first()
        if least[1] == k:
            bound = least[0]
            break
        # Clauses and removals left too few.
        wanted = 4 * max(read, wanted)
    best: dict[str, float] = {}
    for b in blocks:
        best[b["term"]] = max(best.get(b["term"], 0.0), b["best"] * weights[b["term"]])
    total = sum(best.values())
    needed = [b for b in blocks if b["best"] * weights[b["term"]] + total - best[b["term"]] >= bound - SLACK]
    hits = _scored(index, needed, weights, checks)
    work = Work(len(needed), len(blocks), sum(b["postings"] for b in needed), postings)
    return hits.orderBy(*hit_order(best_first=True)).limit(k), work


def search_best(
    entries: DataFrame, index: Index, pattern: Pattern, from_: int = 0, size: int = PAGE_SIZE, fold_case: bool = False
) -> DataFrame:
    """One page of the best hits first, as whole entries; see ``best_hits``."""
    hits, _ = best_hits(index, pattern, from_ + (size if size > 0 else PAGE_SIZE), fold_case)
    shown = durable(hits.orderBy(*hit_order(best_first=True)).offset(from_).limit(size if size > 0 else PAGE_SIZE))
    return final_order(fetch_entries(entries, shown), best_first=True)
