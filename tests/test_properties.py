"""Properties that hold for all inputs."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import batch_search, postings, search, shards, units
from shelfmark.operators.predicates import match
from shelfmark.plans import fixtures as fx
from shelfmark.plans.search_queries import FLAGSHIP, TOKENS_ONLY
from shelfmark.schema import ID, PATTERN_SCHEMA, SHARD, Pattern
from shelfmark.session import work_dir
from shelfmark.sources import generations
from shelfmark.sources import index as stored_index


@pytest.fixture(scope="module")
def entries(spark, small_dir):
    return fx.entries(spark, small_dir).cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_pages_make_up_the_merged_hits(entries):
    merged = search.merged_hits(entries, TOKENS_ONLY).cache()
    pages = []
    while chunk := rows(search.page(merged, len(pages), 23)):
        pages += chunk
    assert pages == rows(merged) and len(pages) > 23
    best = rows(search.merge_hits(merged, best_first=True))
    assert [r[-1] for r in best] == sorted((r[-1] for r in merged.collect()), reverse=True)


def test_halves_make_up_the_whole(entries):
    median = (0, 101, 9)
    low, high = shards.split_keep_low(entries, median), shards.split_keep_high(entries, median)
    assert sorted(rows(low.union(high).select(*ID))) == sorted(rows(entries.select(*ID)))
    assert low.join(high, ID, "left_semi").count() == 0


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_assigned_ids_have_no_gaps(spark, entries, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = units.assign_entry_ids(entries.select(*SHARD, "doc_id", "hash"), ["hash", "doc_id"], container=7)
        by_shard = {}
        for r in got.collect():
            by_shard.setdefault((r["category"], r["shard_id"]), []).append(
                (r["hash"], r["epoch_id"] * 7 + r["entry_id"])
            )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for numbered in by_shard.values():
        assert [n for _, n in sorted(numbered)] == list(range(len(numbered)))


def test_search_does_not_depend_on_partitions(spark, entries):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    answers = []
    for partitions in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        answers.append(rows(search.search(entries.repartition(partitions), FLAGSHIP, 0, 20).select(*ID)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert answers[0] == answers[1] and answers[0]


def test_batch_and_index_agree_with_single_searches(spark, entries):
    path = work_dir(spark, "index")
    stored_index.write_index(entries, path, carry=batch_search.ATTRIBUTES)
    index = stored_index.read_index(spark, path)
    patterns = [
        FLAGSHIP,
        TOKENS_ONLY,
        Pattern(category="Music"),
        Pattern(min_size=300, max_size=2500),
        Pattern(min_ts=datetime(2024, 1, 1, 0, 30), description="ther"),
        Pattern(max_ts=datetime(2024, 1, 1, 1, 15)),
        Pattern(file_name="nothing-at-all"),
        Pattern(),
    ]
    for pattern in patterns:
        single = rows(search.search(entries, pattern, 2, 9).select(*ID))
        indexed = rows(batch_search.search_indexed(entries, index, pattern, 2, 9).select(*ID))
        assert single == indexed, pattern


def test_hit_lists_expire(spark, entries):
    path, at = work_dir(spark, "hits"), datetime(2024, 1, 1, 12)
    merged = search.merged_hits(entries, TOKENS_ONLY)
    search.store_hits(merged, TOKENS_ONLY, at, path)
    n = merged.count()
    assert search.cached_hits(spark, TOKENS_ONLY, datetime(2024, 1, 1, 12, 0, 24), path).count() == n
    assert search.cached_hits(spark, TOKENS_ONLY, datetime(2024, 1, 1, 12, 0, 25), path) is None
    assert search.cached_hits(spark, FLAGSHIP, at, path) is None
    # A changed catalog does not change a list that is young enough.
    fewer = entries.filter("doc_id % 2 = 0")
    page = search.search_cached(fewer, TOKENS_ONLY, datetime(2024, 1, 1, 12, 0, 20), path, 0, n).select(*ID)
    assert sorted(rows(page)) == sorted(rows(merged.join(fewer, ID, "left_semi").select(*ID)))


def test_hit_lists_leave_the_store(spark, entries, monkeypatch):
    """Many searches keep few folders; a list without hits is kept; a failed write is not seen."""
    path, at = work_dir(spark, "hits"), datetime(2024, 1, 1, 12)
    nothing = Pattern(file_name="zzzzzzzz")
    made = []
    plain = search.merged_hits
    monkeypatch.setattr(search, "merged_hits", lambda *a, **k: made.append(1) or plain(*a, **k))
    for i in range(12):
        assert search.search_cached(entries, nothing, at + timedelta(seconds=8 * i), path).isEmpty()
    assert len(made) == 3  # at 0, 32 and 64 seconds
    for i in range(12):
        search.store_hits(plain(entries, nothing), nothing, at + timedelta(seconds=100 + 8 * i), path)
    assert len(generations.folder_names(spark, f"{path}/data")) <= 8
    assert len(generations.version(spark, path).parts) <= 4
    last = at + timedelta(seconds=188)
    with monkeypatch.context() as patch:
        patch.setattr(generations, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            search.store_hits(plain(entries, TOKENS_ONLY), TOKENS_ONLY, last, path)
    assert search.cached_hits(spark, TOKENS_ONLY, last, path) is None


def test_limits_are_applied_before_the_shuffle(entries):
    top = search.shard_topk(search.score(entries, TOKENS_ONLY), 25)
    plan = top._jdf.queryExecution().executedPlan().toString()
    before, after = plan.split("Exchange hashpartitioning")
    assert "Final" in before and "Partial" in after
    merged = search.merge_hits(top, 100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in merged


def test_expanded_tokens_equal_substring_search(spark, entries):
    vocabulary = postings.term_rows(entries, ["file_name"]).select("term").distinct()
    tokens = spark.createDataFrame([(t,) for t in ("e", "in", "the", "ing", "oure", "zzzz")], "token string")
    got = sorted(rows(postings.expand_tokens(tokens, vocabulary)))
    words = [r[0] for r in vocabulary.collect()]
    assert got == sorted((t[0], w) for t in tokens.collect() for w in words if t[0] in w)


def test_postings_of_chosen_terms(spark, entries):
    """Terms that are left out leave the others as they are."""
    chosen = [("description", t) for t in ("ther", "inea", "the", "ou")] + [("file_name", "ing")]
    only = spark.createDataFrame(chosen, "field string, term string")
    whole = postings.build_postings(entries).join(only, ["field", "term"], "left_semi")
    expected = sorted(rows(whole.select("field", "term", *ID, "length", "tf")))
    got = postings.build_postings(entries, only=only)
    assert sorted(rows(got.select("field", "term", *ID, "length", "tf"))) == expected
    assert expected


def test_odd_tokens(spark, entries):
    """Blanks and wildcards split and match alike for one pattern and for a table of them."""
    names = ["in\x0ber", "in\u00a0er", "IN\fer", "i?g", "an*", "*", "??", "o-n", "\\*", "e*e?n th", " \t", "i?g\nzzz"]
    patterns = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pattern_id int, file_name string")
    for field in PATTERN_SCHEMA.fields[2:]:
        patterns = patterns.withColumn(field.name, F.lit(None).cast(field.dataType))
    many = batch_search.batch_hits(entries, patterns).groupBy("pattern_id").count().collect()
    found = {r["pattern_id"]: r["count"] for r in many}
    for i, name in enumerate(names):
        single = match(entries, Pattern(file_name=name)).count()
        assert found.get(i, 0) == single, name
    assert found.get(0, 0) == 0 and found[3] and found[4] and found[5]


def test_pages_past_a_thousand_hits(spark, entries):
    """Nothing is cut: every hit is counted, and the last page has the strongest."""
    many = entries.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(11))))
    many = many.withColumn("epoch_id", F.col("epoch_id") + F.col("copy") * 1000)
    pattern = Pattern(file_name="e in")
    hits = search.merged_hits(many, pattern)
    total = hits.count()
    assert total == match(many, pattern).count() and total > 1100
    last = search.page(hits, total - 3, 10).collect()
    assert len(last) == 3 and last[-1]["score"] == hits.agg(F.max("score")).first()[0]
    assert search.search(many, pattern, 1050, 20).count() == 20
