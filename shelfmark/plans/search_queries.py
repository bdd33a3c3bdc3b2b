"""Search: index tables, scores, pages and batches."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.terms import terms
from shelfmark.operators import batch_search, best_blocks, postings, search
from shelfmark.operators.predicates import match
from shelfmark.operators.replicas import union_results
from shelfmark.plans import fixtures as fx
from shelfmark.plans.catalog_queries import any_contains_sql, any_equals_sql, terms_sql
from shelfmark.plans.registry import Query
from shelfmark.schema import ID, SHARD, Pattern
from shelfmark.session import work_dir
from shelfmark.sources import index as stored

Spark = SparkSession

FLAGSHIP = Pattern(file_name="ing ou THE", min_size=100, language="en", description="ther inea of")
TOKENS_ONLY = Pattern(file_name="an in er")
DESCRIBED = Pattern(category="Video", description="ther ther inea")

IDS = "epoch_id, leader_id, entry_id"
HIT = f"category, shard_id, {IDS}, score"
ROW = f"{IDS}, url, file_name, file_size, uploaded, language, category"
ROW_COLUMNS = [*ID, "url", "file_name", "file_size", "uploaded", "language", "category"]
ANALYSED = f"""analysed AS MATERIALIZED (SELECT *, {terms_sql('file_name')} AS ft, {terms_sql('description')} AS dt FROM entries)"""


def _weight_sql(token: str, source: str) -> str:
    return (
        f"power(1 + ln((SELECT count(*) FROM {source}) / "
        f"((SELECT count(*) FROM {source} WHERE list_contains(dt, '{token}')) + 1)), 2)"
    )


def score_sql(pattern: Pattern, source: str = "analysed") -> str:
    parts = []
    if tokens := pattern.file_tokens():
        m = " + ".join(
            f"CAST(len(list_filter(ft, lambda t: contains(t, '{t}'))) > 0 AS INT)" for t in tokens
        )
        parts.append(f"(CAST(({m}) AS DOUBLE) * ({m}) / {len(tokens)})")
    if tokens := pattern.description_tokens():
        parts.extend(
            f"(sqrt(len(list_filter(dt, lambda t: t = '{t}'))) * {_weight_sql(t, source)} / sqrt(greatest(len(dt), 1)))"
            for t in tokens
        )
    total = " + ".join(parts) if parts else "0.0"
    return f"floor(1e9 * ({total}) + 0.5) / 1e9"


def where_sql(pattern: Pattern) -> str:
    tests = []
    if pattern.category:
        tests.append(f"category = '{pattern.category}'")
    if pattern.language:
        tests.append(f"language = '{pattern.language}'")
    if pattern.max_size:
        tests.append(f"file_size BETWEEN {pattern.min_size} AND {pattern.max_size}")
    elif pattern.min_size:
        tests.append(f"file_size >= {pattern.min_size}")
    if pattern.file_name:
        tests.append(any_contains_sql("file_name", pattern.file_tokens()))
    if pattern.description:
        tests.append(any_equals_sql("description", pattern.description_tokens()))
    return " AND ".join(tests)


def hits_sql(pattern: Pattern) -> str:
    return (
        f"hits AS (SELECT category, shard_id, {IDS}, {score_sql(pattern)} AS score "
        f"FROM analysed WHERE {where_sql(pattern)})"
    )


TOPK = f"""topk AS (SELECT {HIT} FROM (SELECT *, row_number() OVER (PARTITION BY category, shard_id
ORDER BY score DESC, {IDS}) AS rn FROM hits) WHERE rn <= 25)"""
MERGED = f"merged AS (SELECT {HIT} FROM hits)"


def page_sql(start: int, size: int) -> str:
    return f"page AS (SELECT * FROM merged ORDER BY score, {IDS} LIMIT {size} OFFSET {start})"


def _search_sql(pattern: Pattern, body: str, *more: str) -> str:
    return fx.sql("entries", body, ANALYSED, hits_sql(pattern), TOPK, MERGED, *more)


def _hits(spark: Spark, d: str, pattern: Pattern = FLAGSHIP) -> DataFrame:
    return search.score(fx.entries(spark, d), pattern)


def _merged(spark: Spark, d: str, pattern: Pattern = FLAGSHIP) -> DataFrame:
    return search.merge_hits(_hits(spark, d, pattern))


# One stored index per session and folder of tables.
_STORED: dict[tuple[str, str], str] = {}


def stored_index(spark: Spark, d: str) -> stored.Index:
    """The index of the catalog, written when it is first asked for."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        path = work_dir(spark, "index")
        stored.write_index(fx.entries(spark, d), path, carry=batch_search.ATTRIBUTES)
        _STORED[key] = path
    return stored.read_index(spark, _STORED[key])


def search_page(spark: Spark, d: str) -> DataFrame:
    """The flagship: one page of a search with every kind of clause, from the stored index.

    Texts are read for the rows of the page only.
    """
    found = batch_search.search_indexed(
        fx.entries(spark, d), stored_index(spark, d), FLAGSHIP, 10, 15
    )
    return found.select(*ROW_COLUMNS)


def _search_page_scan(spark: Spark, d: str) -> DataFrame:
    """The same without an index."""
    return search.search(fx.entries(spark, d), FLAGSHIP, 10, 15).select(*ROW_COLUMNS)


def _search_page_cached(spark: Spark, d: str) -> DataFrame:
    """Two pages: the first makes the hit list, the second is read from it."""
    path, now = work_dir(spark, "hits"), datetime(2024, 1, 1, 12)
    rows = fx.entries(spark, d)
    search.search_cached(rows, TOKENS_ONLY, now, path, 0, 10)
    found = search.search_cached(rows, TOKENS_ONLY, now + timedelta(seconds=20), path, 10, 30)
    return found.select(*ROW_COLUMNS)


def _maintained(spark: Spark, d: str) -> tuple[str, DataFrame]:
    """An index written for some entries, to which the others are added."""
    path, rows = work_dir(spark, "index"), fx.entries(spark, d)
    old = F.col("epoch_id") % 3 != 1
    stored.write_index(rows.filter(old), path, carry=batch_search.ATTRIBUTES)
    stored.append_index(rows.filter(~old), path, carry=batch_search.ATTRIBUTES)
    return path, rows


def _index_append(spark: Spark, d: str) -> DataFrame:
    path, _ = _maintained(spark, d)
    index = stored.read_index(spark, path)
    return index.vocabulary.select("field", "term", "df", F.lit(index.documents).cast("long").alias("documents"))


def _index_delete(spark: Spark, d: str) -> DataFrame:
    """Entries are taken out, and some of them added again."""
    path, rows = _maintained(spark, d)
    stored.delete_index(rows.filter("doc_id % 5 = 0"), path)
    stored.append_index(rows.filter("doc_id % 10 = 0"), path, carry=batch_search.ATTRIBUTES)
    index = stored.read_index(spark, path)
    counted = index.postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("postings"))
    return index.vocabulary.join(counted, ["field", "term"]).select(
        "field", "term", "df", "postings", F.lit(index.documents).cast("long").alias("documents")
    )


def _index_sql(where: str, columns: str) -> str:
    return fx.sql(
        "entries",
        f"""SELECT field, term, count(*) AS df, {columns} FROM (
SELECT 'file_name' AS field, unnest(list_distinct(ft)) AS term FROM analysed WHERE {where}
UNION ALL SELECT 'description' AS field, unnest(list_distinct(dt)) AS term FROM analysed WHERE {where})
GROUP BY field, term""",
        ANALYSED,
    )


def _tokens(spark: Spark, d: str) -> DataFrame:
    words = fx.table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    lengths = F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("n")
    pieces = words.select("w", lengths)
    return pieces.select(F.substr("w", F.lit(1), F.col("n")).alias("token")).distinct()


TOKENS_SQL = """tokens AS (SELECT DISTINCT substring(w, 1, n) AS token
FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part), (VALUES (1), (2), (4)) l(n))"""


def _vocab_contains_join(spark: Spark, d: str) -> DataFrame:
    names = fx.entries(spark, d).select(F.explode(terms(F.col("file_name"))).alias("term"))
    return postings.expand_tokens(_tokens(spark, d), names.distinct())


def _write_and_read_index(spark: Spark, d: str) -> DataFrame:
    """The batch answered from stored index tables."""
    rows = fx.entries(spark, d)
    path = work_dir(spark, "index")
    stored.write_index(rows, path, carry=batch_search.ATTRIBUTES)
    found = batch_search.search_many(rows, fx.patterns(spark), stored.read_index(spark, path))
    return found.select("pattern_id", "rank", "score", *ROW_COLUMNS)


def _search_batch(spark: Spark, d: str) -> DataFrame:
    found = batch_search.search_many(fx.entries(spark, d), fx.patterns(spark))
    return found.select("pattern_id", "rank", "score", *ROW_COLUMNS)


def _pattern_entries_join(spark: Spark, d: str) -> DataFrame:
    hits = batch_search.batch_hits(fx.entries(spark, d), fx.patterns(spark))
    return hits.select("pattern_id", *ID)


BATCH_CTES = [
    ANALYSED,
    fx.patterns_sql(),
    r"""prepared AS (SELECT *, list_filter(string_split_regex(lower(file_name), '[ \t\n\r\f]+'), lambda x: x <> '') AS toks,
list_filter(string_split_regex(description, '[ \t\n\r\f]+'), lambda x: x <> '') AS words FROM patterns)""",
    "asked AS (SELECT pattern_id, unnest(words) AS w FROM prepared)",
    """dfs AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT w FROM asked) q
JOIN analysed ON list_contains(dt, w) GROUP BY w)""",
    """described AS (SELECT pattern_id, doc_id, sum(sqrt(len(list_filter(dt, lambda x: x = w)))
* power(1 + ln((SELECT count(*) FROM entries) / (df + 1)), 2) / sqrt(len(dt))) AS gain
FROM asked JOIN dfs USING (w) JOIN analysed ON list_contains(dt, w) GROUP BY pattern_id, doc_id)""",
    """matched AS (SELECT p.pattern_id, e.doc_id, e.epoch_id, e.leader_id, e.entry_id, e.category, e.shard_id, toks,
len(list_filter(toks, lambda k: len(list_filter(ft, lambda t: contains(t, k))) > 0)) AS m
FROM prepared p JOIN analysed e ON (p.language IS NULL OR p.language = e.language)
AND (p.category IS NULL OR p.category = e.category)
AND CASE WHEN coalesce(min_size, 0) >= 0 AND coalesce(max_size, 0) > 0 THEN file_size BETWEEN coalesce(min_size, 0) AND max_size
WHEN coalesce(min_size, 0) > 0 AND coalesce(max_size, 0) = 0 THEN file_size >= min_size ELSE true END
AND (min_ts IS NULL OR uploaded >= min_ts) AND (max_ts IS NULL OR uploaded <= max_ts)
WHERE p.file_name IS NOT NULL OR p.description IS NOT NULL OR p.language IS NOT NULL OR p.category IS NOT NULL
OR coalesce(max_size, 0) > 0 OR coalesce(min_size, 0) > 0 OR min_ts IS NOT NULL OR max_ts IS NOT NULL)""",
    """hits AS (SELECT m.pattern_id, m.epoch_id, m.leader_id, m.entry_id, m.category, m.shard_id,
floor(1e9 * (CASE WHEN p.file_name IS NULL THEN 0.0 ELSE CAST(m.m AS DOUBLE) * m.m / len(p.toks) END + coalesce(gain, 0.0)) + 0.5) / 1e9 AS score
FROM matched m JOIN prepared p ON m.pattern_id = p.pattern_id
LEFT JOIN described d ON d.pattern_id = m.pattern_id AND d.doc_id = m.doc_id
WHERE (p.file_name IS NULL OR m.m > 0) AND (p.description IS NULL OR gain IS NOT NULL))""",
]
BATCH_SQL = fx.sql(
    "entries",
    f"""SELECT pattern_id, rank, score, e.epoch_id, e.leader_id, e.entry_id, url, e.file_name, file_size, uploaded,
e.language, e.category FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY score, {IDS}) AS rank
FROM hits) r JOIN patterns p USING (pattern_id)
JOIN entries e ON e.epoch_id = r.epoch_id AND e.leader_id = r.leader_id AND e.entry_id = r.entry_id
WHERE rank > page_from AND rank <= page_from + CASE WHEN page_size <= 0 THEN 10 ELSE page_size END""",
    *BATCH_CTES,
)


def _search_best_blocks(spark: Spark, d: str) -> DataFrame:
    """The best hits first, from the blocks that can hold them."""
    hits, _ = best_blocks.best_hits(stored_index(spark, d), DESCRIBED, 25)
    return hits


def _index_compact(spark: Spark, d: str) -> DataFrame:
    """Entries are added, taken out and added again, and what is left is merged into one segment."""
    path, rows = _maintained(spark, d)
    stored.delete_index(rows.filter("doc_id % 3 = 0"), path)
    stored.append_index(rows.filter("doc_id % 6 = 0"), path, carry=batch_search.ATTRIBUTES)
    stored.compact_index(spark, path, most_segments=1)
    index = stored.read_index(spark, path)
    counted = index.postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("postings"))
    return index.vocabulary.join(counted, ["field", "term"]).select(
        "field", "term", "df", "postings", F.lit(index.documents).cast("long").alias("documents")
    )


def _hitlist_cache(spark: Spark, d: str) -> DataFrame:
    """Three hit lists are kept; the one that is young enough and newest is read."""
    path, now = work_dir(spark, "hits"), datetime(2024, 1, 1, 12)
    merged = _merged(spark, d, TOKENS_ONLY)
    search.store_hits(search.page(merged), TOKENS_ONLY, now - timedelta(seconds=20), path)
    search.store_hits(merged, TOKENS_ONLY, now - timedelta(seconds=10), path)
    search.store_hits(_merged(spark, d, DESCRIBED), DESCRIBED, now, path)
    return search.cached_hits(spark, TOKENS_ONLY, now, path)


def _fetch_by_ids(spark: Spark, d: str) -> DataFrame:
    wanted = fx.replica_entries(spark, d).filter("replica_id = 1").select(*ID)
    extra = wanted.withColumn("epoch_id", F.col("epoch_id") + 100_000)
    return search.fetch_ids(fx.entries(spark, d), wanted.unionByName(extra)).select(*ROW_COLUMNS)


def _expected_rounds(spark: Spark, d: str) -> DataFrame:
    rounds = fx.replies(spark, d).select("round_id").distinct()
    return rounds.withColumn("expected", F.hour("round_id") % 5)


QUERIES: dict[str, Query] = {
    "build_postings": Query(
        lambda spark, d: postings.build_postings(fx.entries(spark, d)),
        fx.sql(
            "entries",
            f"""SELECT field, term, {IDS}, length, count(*) AS tf FROM (
SELECT {IDS}, 'file_name' AS field, len(ft) AS length, unnest(ft) AS term FROM analysed
UNION ALL SELECT {IDS}, 'description' AS field, len(dt) AS length, unnest(dt) AS term FROM analysed)
GROUP BY field, term, {IDS}, length""",
            ANALYSED,
        ),
    ),
    "document_counts": Query(
        lambda spark, d: postings.document_counts(postings.build_postings(fx.entries(spark, d))),
        fx.sql(
            "entries",
            """SELECT field, term, count(*) AS df FROM (
SELECT 'file_name' AS field, unnest(list_distinct(ft)) AS term FROM analysed
UNION ALL SELECT 'description' AS field, unnest(list_distinct(dt)) AS term FROM analysed)
GROUP BY field, term""",
            ANALYSED,
        ),
    ),
    "vocab_contains_join": Query(
        _vocab_contains_join,
        fx.sql(
            "entries",
            "SELECT DISTINCT token, term FROM tokens, (SELECT DISTINCT unnest(ft) AS term FROM analysed) v WHERE contains(term, token)",
            ANALYSED,
            TOKENS_SQL,
        ),
    ),
    "score_hits": Query(_hits, _search_sql(FLAGSHIP, f"SELECT {HIT} FROM hits")),
    "score_hits_description": Query(
        lambda spark, d: _hits(spark, d, DESCRIBED), _search_sql(DESCRIBED, f"SELECT {HIT} FROM hits")
    ),
    "shard_topk": Query(
        lambda spark, d: search.shard_topk(_hits(spark, d, TOKENS_ONLY), 25),
        _search_sql(TOKENS_ONLY, f"SELECT {HIT} FROM topk"),
    ),
    "shard_topk_entries": Query(
        lambda spark, d: search.shard_topk_entries(fx.entries(spark, d), TOKENS_ONLY, 5).select(
            *ROW_COLUMNS, "score"
        ),
        _search_sql(
            TOKENS_ONLY,
            f"""SELECT {', '.join('e.' + c for c in ROW_COLUMNS)}, score FROM (SELECT *, row_number() OVER (
PARTITION BY category, shard_id ORDER BY score DESC, {IDS}) AS rn FROM hits) h
JOIN entries e USING ({IDS}) WHERE rn <= 5""",
        ),
    ),
    "dedup_results": Query(
        lambda spark, d: search.dedup(fx.replica_entries(spark, d).drop("replica_id")),
        fx.sql("replica_entries", f"SELECT DISTINCT {IDS}, hash FROM replica_entries"),
    ),
    "first_reply_per_shard": Query(
        lambda spark, d: search.first_reply(fx.replies(spark, d)),
        fx.sql(
            "replies",
            """SELECT round_id, shard_id, ts, event_id FROM (SELECT *, row_number() OVER (
PARTITION BY round_id, shard_id ORDER BY ts, event_id) AS rn FROM replies) WHERE rn = 1""",
        ),
    ),
    "shards_complete": Query(
        lambda spark, d: search.round_complete(fx.replies(spark, d), _expected_rounds(spark, d)),
        fx.sql(
            "replies",
            """SELECT round_id, hour(round_id) % 5 AS expected, count(DISTINCT shard_id) AS replied,
hour(round_id) % 5 <> 0 AND count(DISTINCT shard_id) >= hour(round_id) % 5 AS complete
FROM replies GROUP BY round_id""",
        ),
    ),
    "merge_hits": Query(
        lambda spark, d: search.merge_hits(_hits(spark, d, TOKENS_ONLY), 100),
        _search_sql(TOKENS_ONLY, f"SELECT {HIT} FROM hits ORDER BY score, {IDS} LIMIT 100"),
    ),
    "sort_hits": Query(
        lambda spark, d: _hits(spark, d, TOKENS_ONLY).orderBy(*search.hit_order()),
        _search_sql(TOKENS_ONLY, f"SELECT {HIT} FROM hits ORDER BY score, {IDS}"),
    ),
    "hit_count": Query(
        lambda spark, d: search.num_hits(_merged(spark, d, TOKENS_ONLY)),
        _search_sql(TOKENS_ONLY, "SELECT count(*) AS hits FROM merged"),
    ),
    "count_matches": Query(
        lambda spark, d: match(fx.entries(spark, d), FLAGSHIP).agg(F.count(F.lit(1)).alias("hits")),
        _search_sql(FLAGSHIP, "SELECT count(*) AS hits FROM hits"),
    ),
    "page_hits": Query(
        lambda spark, d: search.page(_merged(spark, d, TOKENS_ONLY), 20, 0),
        _search_sql(TOKENS_ONLY, f"SELECT {HIT} FROM page", page_sql(20, 10)),
    ),
    "retain_page_per_shard": Query(
        lambda spark, d: search.retain(
            search.shard_topk(_hits(spark, d, TOKENS_ONLY), 25),
            search.page(_merged(spark, d, TOKENS_ONLY), 5, 30),
        ),
        _search_sql(
            TOKENS_ONLY,
            f"SELECT {HIT} FROM topk SEMI JOIN page USING ({IDS}, score)",
            page_sql(5, 30),
        ),
    ),
    "fetch_entries": Query(
        lambda spark, d: search.fetch_entries(
            fx.entries(spark, d), search.page(_merged(spark, d, TOKENS_ONLY), 5, 30)
        ).select(*ROW_COLUMNS, "score"),
        _search_sql(
            TOKENS_ONLY,
            f"SELECT {', '.join('e.' + c for c in ROW_COLUMNS)}, score FROM page JOIN entries e USING ({IDS})",
            page_sql(5, 30),
        ),
    ),
    "fetch_by_ids": Query(
        _fetch_by_ids,
        fx.sql(
            "replica_entries",
            f"SELECT {ROW} FROM entries SEMI JOIN (SELECT * FROM replica_entries WHERE replica_id = 1) USING ({IDS})",
        ),
    ),
    "final_order": Query(
        lambda spark, d: search.final_order(
            search.fetch_entries(
                fx.entries(spark, d), search.page(_merged(spark, d, TOKENS_ONLY), 0, 40)
            )
        ).select(*ROW_COLUMNS),
        _search_sql(
            TOKENS_ONLY,
            f"SELECT {', '.join('e.' + c for c in ROW_COLUMNS)} FROM page JOIN entries e USING ({IDS}) ORDER BY score, {IDS}",
            page_sql(0, 40),
        ),
    ),
    "search_page": Query(
        search_page,
        _search_sql(
            FLAGSHIP,
            f"SELECT {', '.join('e.' + c for c in ROW_COLUMNS)} FROM page JOIN entries e USING ({IDS}) ORDER BY score, {IDS}",
            page_sql(10, 15),
        ),
    ),
    "search_page_scan": Query(
        _search_page_scan,
        _search_sql(
            FLAGSHIP,
            f"SELECT {', '.join('e.' + c for c in ROW_COLUMNS)} FROM page JOIN entries e USING ({IDS}) ORDER BY score, {IDS}",
            page_sql(10, 15),
        ),
    ),
    "search_page_cached": Query(
        _search_page_cached,
        _search_sql(
            TOKENS_ONLY,
            f"SELECT {', '.join('e.' + c for c in ROW_COLUMNS)} FROM page JOIN entries e USING ({IDS})",
            page_sql(10, 30),
        ),
    ),
    "index_append": Query(_index_append, _index_sql("true", "(SELECT count(*) FROM entries) AS documents")),
    "index_delete": Query(
        _index_delete,
        _index_sql(
            "doc_id % 5 <> 0 OR doc_id % 10 = 0",
            "count(*) AS postings, (SELECT count(*) FROM entries WHERE doc_id % 5 <> 0 OR doc_id % 10 = 0) AS documents",
        ),
    ),
    "index_compact": Query(
        _index_compact,
        _index_sql(
            "doc_id % 3 <> 0 OR doc_id % 6 = 0",
            "count(*) AS postings, (SELECT count(*) FROM entries WHERE doc_id % 3 <> 0 OR doc_id % 6 = 0) AS documents",
        ),
    ),
    "search_best_blocks": Query(
        _search_best_blocks,
        _search_sql(DESCRIBED, f"SELECT {HIT} FROM hits ORDER BY score DESC, {IDS} LIMIT 25"),
    ),
    "search_batch": Query(_search_batch, BATCH_SQL),
    "search_batch_stored_index": Query(_write_and_read_index, BATCH_SQL),
    "pattern_entries_join": Query(
        _pattern_entries_join, fx.sql("entries", f"SELECT pattern_id, {IDS} FROM hits", *BATCH_CTES)
    ),
    "search_merge_rescore": Query(
        lambda spark, d: search.search_union(fx.entries(spark, d), FLAGSHIP, 25, 60),
        fx.sql(
            "entries",
            f"""SELECT category, shard_id, {IDS}, {score_sql(FLAGSHIP, 'united')} AS score FROM united
WHERE {where_sql(FLAGSHIP)} ORDER BY score DESC, {IDS} LIMIT 60""",
            ANALYSED,
            hits_sql(FLAGSHIP),
            TOPK,
            f"united AS MATERIALIZED (SELECT a.* FROM analysed a SEMI JOIN topk USING ({IDS}))",
        ),
    ),
    "hitlist_cache": Query(
        _hitlist_cache, _search_sql(TOKENS_ONLY, f"SELECT {HIT} FROM merged")
    ),
    "hit_collector": Query(
        lambda spark, d: search.search(fx.entries(spark, d), TOKENS_ONLY, mode="count"),
        _search_sql(TOKENS_ONLY, "SELECT count(*) AS hits FROM hits"),
    ),
    "union_results": Query(
        lambda spark, d: union_results(
            *(
                _hits(spark, d, Pattern(file_name="an", category=c)).select(*SHARD, *ID, "score")
                for c in ("Video", "Books")
            )
        ),
        fx.sql(
            "entries",
            f"""SELECT category, shard_id, {IDS}, 1.0::DOUBLE AS score FROM entries
WHERE category IN ('Video', 'Books') AND {any_contains_sql('file_name', ['an'])}""",
        ),
    ),
}
