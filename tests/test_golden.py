"""Facts about small hand-made tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import overlay
from shelfmark.functions.ids import majority, page_end, round2
from shelfmark.functions.terms import any_term_contains, has_term, term_count, terms
from shelfmark.operators import counts, peers, replicas, shards, units
from shelfmark.operators import predicates as p
from shelfmark.operators.search import score
from shelfmark.schema import ENTRY_SCHEMA, ID, Pattern
from shelfmark.session import work_dir
from shelfmark.sources import catalog

UNIT_COLUMNS = "epoch_id long, leader_id int, num_entries long, status string, pull_status string"


def entry(i: int, **changes):
    row = {
        "epoch_id": 0, "leader_id": 0, "entry_id": i, "global_id": f"global{i}", "url": "url",
        "file_name": f"file{i}", "file_size": 0, "uploaded": None, "language": None,
        "category": "Video", "description": f"description{i}", "hash": f"hash{i}", "leader_key": None,
    }
    row.update(changes)
    return tuple(row[f.name] for f in ENTRY_SCHEMA.fields)


def unit_rows(spark, *rows):
    return spark.createDataFrame(list(rows), UNIT_COLUMNS)


def ids(df):
    return [tuple(r) for r in df.select(*ID).collect()]


def test_store_round_trip(spark):
    path = work_dir(spark, "store")
    catalog.append_entries(spark.createDataFrame([entry(i) for i in range(10)], ENTRY_SCHEMA), path)
    assert catalog.read_entries(spark, path).count() == 10
    catalog.append_entries(
        spark.createDataFrame([entry(i) for i in range(10, 20)], ENTRY_SCHEMA), path
    )
    stored = catalog.read_entries(spark, path)
    assert p.find_id_range(stored, 0, 20, 100, "entry_id").count() == 20
    assert counts.min_max_id(stored, "entry_id").first()["min_id"] == 0
    first = stored.filter("entry_id = 3").first()
    assert (first["language"], first["leader_key"], first["file_name"]) == ("", "", "file3")
    catalog.truncate(spark, path)
    assert catalog.read_entries(spark, path).count() == 0


def test_normalize(spark):
    rows = spark.createDataFrame([entry(1)], ENTRY_SCHEMA)
    done = catalog.normalize_entries(rows, datetime(2024, 1, 1)).first()
    assert (done["language"], done["uploaded"], done["leader_key"]) == (
        "english", datetime(2024, 1, 1), "",
    )


def test_filters_reach_the_scan(spark):
    path = work_dir(spark, "store")
    catalog.append_entries(spark.createDataFrame([entry(i) for i in range(10)], ENTRY_SCHEMA), path)
    rows = catalog.read_entries(spark, path, complete=True)
    found = p.match(rows, Pattern(min_size=5, category="Music", language="en")).select(*ID)
    plan = found._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(file_size,5)" in plan and "EqualTo(language,en)" in plan
    assert "PartitionFilters: [isnotnull(category" in plan
    assert "description" not in plan.split("ReadSchema")[1]


def test_markers(spark):
    rows = spark.createDataFrame([(0, 100), (0, 200), (1, 29)], "epoch_id long, leader_id int")
    assert tuple(counts.last_marker(rows).first()) == (1, 29)
    assert counts.count_markers(rows.union(rows)).first()["n"] == 3
    assert counts.last_marker(rows.limit(0)).count() == 0


def test_boolean_query_and_delete(spark):
    rows = spark.createDataFrame(
        [(0, 0), (0, 1), (1, 0), (1, 2)], "epoch_id long, counter int"
    )
    assert rows.filter((F.col("epoch_id") == 1) & (F.col("counter") == 2)).count() == 1
    assert p.delete_where(rows, F.col("counter") == 0).count() == 2


def test_median(spark):
    rows = [(10, 0, i) for i in range(10)] + [(12, 0, i) for i in range(5)] + [(11, 0, i) for i in range(5)]
    df = spark.createDataFrame(rows, "epoch_id long, leader_id int, entry_id long")
    assert tuple(counts.median_id(df).select(*ID).first()) == (11, 0, 0)


def test_timeline(spark):
    rows = unit_rows(
        spark,
        (0, 100, 100, "COMPLETED", "COMPLETED"),
        (1, 100, 100, "COMPLETED", "SKIP"),
        (2, 100, 100, "COMPLETED", "PENDING"),
        (2, 200, 10, "ONGOING", "PENDING"),
        (5, 100, 100, "COMPLETED", "PENDING"),
    )
    following = {
        (r["epoch_id"], r["leader_id"]): (r["next_epoch"], r["next_leader"])
        for r in units.next_unit(rows).collect()
    }
    assert following == {
        (0, 100): (1, 100), (1, 100): (2, 100), (2, 100): (2, 200),
        (2, 200): (None, None), (5, 100): (None, None),
    }
    pending = {
        (r["epoch_id"], r["leader_id"]): (r["next_epoch"], r["next_leader"])
        for r in units.next_pending_unit(rows).collect()
    }
    assert pending[(0, 100)] == (2, 100) and pending[(2, 200)] == (None, None)
    assert [tuple(r)[:2] for r in units.next_units(rows, (0, 100)).collect()] == [
        (1, 100), (2, 100), (2, 200),
    ]
    assert tuple(units.first_unit(rows).first())[:2] == (0, 100)
    assert tuple(counts.last_unit(rows).first()) == (5, 100, 100)
    safe = {r["epoch_id"]: r["safe"] for r in units.timeline_safe_prefix(rows).collect()}
    assert safe == {0: True, 1: True, 2: True, 5: False}
    nothing = units.timeline_safe_prefix(rows.filter("epoch_id > 0"))
    assert not any(r["safe"] for r in nothing.collect())


def test_tracking(spark):
    rows = unit_rows(
        spark,
        (0, 100, 3, "COMPLETED", "COMPLETED"),
        (1, 100, 3, "COMPLETED", "SKIP"),
        (2, 100, 3, "COMPLETED", "PENDING"),
        (3, 100, 1, "ONGOING", "PENDING"),
    )
    at = lambda *done: spark.createDataFrame(
        list(done), "epoch_id long, leader_id int, next_id long"
    )
    assert tuple(units.tracked_unit(rows, at()).first())[:3] == (0, 100, 0)
    assert tuple(units.tracked_unit(rows, at((0, 100, 3))).first())[:3] == (2, 100, 0)
    done = at((0, 100, 3), (2, 100, 3))
    assert tuple(units.tracked_unit(rows, done).first())[:3] == (3, 100, 0)


def test_latest_unit(spark):
    reports = spark.createDataFrame(
        [(0, 1, 5, "ONGOING", "PENDING", 0), (0, 1, 9, "COMPLETED", "SKIP", 1), (0, 1, 4, "ONGOING", "COMPLETED", 2)],
        UNIT_COLUMNS + ", seq long",
    )
    assert tuple(counts.latest_unit(reports).first()) == (0, 1, 9, "COMPLETED", "PENDING")


def test_skip_list(spark):
    rows = unit_rows(
        spark, *[(e, 100 if e < 5 else 200, 100, "COMPLETED", "PENDING") for e in range(10)]
    )
    median = (6, 200, 12)
    low = shards.skip_list(rows, (3, 100), median, keep_low=True)
    high = shards.skip_list(rows, (3, 100), median, keep_low=False)
    assert sorted(r["epoch_id"] for r in low.collect()) == [6, 7, 8, 9]
    assert sorted(r["epoch_id"] for r in high.collect()) == [3, 4, 5]
    marked = units.mark_skip(rows, high).filter("pull_status = 'SKIP'")
    assert sorted(r["epoch_id"] for r in marked.collect()) == [3, 4, 5]


PEER_COLUMNS = (
    "node_id long, category_id int, partition_id long, depth int, num_entries long, "
    "is_lg_member boolean, is_nated boolean, age int"
)


def peer(node, **changes):
    row = {"category": 0, "partition": 0, "depth": 0, "entries": 0, "member": False, "nated": False, "age": 0}
    row.update(changes)
    return (node, row["category"], row["partition"], row["depth"], row["entries"], row["member"], row["nated"], row["age"])


def test_cohort(spark):
    rows = spark.createDataFrame([peer(n) for n in range(1, 11)], PEER_COLUMNS)
    cohort = peers.best_node_cohort(rows, 6).orderBy("place").collect()
    assert [r["node_id"] for r in cohort] == [2, 3, 4, 5, 6, 7]
    assert peers.best_node_cohort(rows, 6, candidate=1).count() == 6
    # A worse candidate, and one behind a NAT, get nothing.
    assert peers.best_node_cohort(rows, 6, candidate=10).count() == 0
    hidden = spark.createDataFrame([peer(1, nated=True), *(peer(n) for n in range(2, 5))], PEER_COLUMNS)
    assert peers.best_node_cohort(hidden, 6).count() == 0
    mixed = spark.createDataFrame([peer(1), peer(2, nated=True), peer(3, member=True)], PEER_COLUMNS)
    assert [r["node_id"] for r in peers.best_node_cohort(mixed, 6).collect()] == [1]
    ignoring = peers.best_node_cohort(mixed, 6, ignore_membership=True).collect()
    assert [(r["best_id"], r["node_id"]) for r in ignoring] == [(1, 3)]


def test_rank_order(spark):
    rows = spark.createDataFrame(
        [peer(1), peer(2, entries=9), peer(3, depth=1), peer(4, member=True), peer(5, entries=9)],
        PEER_COLUMNS,
    )
    ranked = peers.rank_peers(rows).orderBy("rank").collect()
    assert [r["node_id"] for r in ranked] == [4, 3, 2, 5, 1]
    assert [r["node_id"] for r in peers.peers_above_k(rows, 5, 3).collect()] == [4, 3, 2]
    assert [r["node_id"] for r in peers.peers_above_k(rows, 5, 10).collect()] == [4, 3, 2, 5]


def test_overlay(spark):
    row = spark.range(1).select(
        overlay.overlay_encode(F.lit(2), F.lit(2), F.lit(3), F.lit(0)).alias("x")
    )
    x = F.col("x")
    parts = row.select(
        overlay.overlay_type(x), overlay.overlay_depth(x), overlay.overlay_partition(x), overlay.overlay_category(x)
    ).first()
    assert tuple(parts) == (2, 2, 3, 0)
    bad = spark.range(1).select(overlay.overlay_encode(F.lit(2), F.lit(16), F.lit(3), F.lit(0)))
    assert bad.first()[0] is None
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(
            overlay.overlay_encode(F.lit(2), F.lit(0), F.lit(1024), F.lit(0), strict=True)
        ).collect()


def test_shard_bits(spark):
    lit = F.lit
    got = spark.range(1).select(
        overlay.shard_of_node(lit(13), lit(3)),
        overlay.split_side(lit(13), lit(0)),
        overlay.split_side(lit(13), lit(1)),
        overlay.sibling_partition(lit(5), lit(3)),
        overlay.sibling_partition(lit(0), lit(0)),
        overlay.parent_partition(lit(5), lit(3)),
        overlay.partition_bits(lit(5), lit(3)),
        overlay.partition_bits(lit(0), lit(0)),
        overlay.shard_of_node(lit(-3), lit(2)),
    ).first()
    assert tuple(got) == (5, 1, 0, 1, 0, 1, [True, False, True], [False], 1)


def test_small_arithmetic(spark):
    got = spark.range(1).select(
        majority(F.lit(3)), majority(F.lit(4)), round2(F.lit(1.005 * 100)),
        page_end(F.lit(5), F.lit(0), F.lit(100)), page_end(F.lit(95), F.lit(10), F.lit(100)),
    ).first()
    assert tuple(got) == (2, 2, 100.5, 15, 100)


TEXTS = [
    "The quick-brown Fox, foxes & vixen's 42nd",
    "in INTO within; Éclair éclair",
    "",
    None,
    "of the and",
    "a_b a.b ab",
]


@pytest.mark.parametrize("token", ["fox", "in", "the", "he", "42", "clair", "éclair", "o-f", "b", "zz", "x's", "ab"])
def test_token_tests_equal_the_term_list(spark, token):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    col = F.col("t")
    for r in df.select(
        terms(col).alias("terms"),
        any_term_contains(col, token).alias("inside"),
        has_term(col, token).alias("whole"),
        term_count(col, token).alias("times"),
    ).collect():
        assert r["inside"] == any(token in t for t in r["terms"])
        assert r["whole"] == (token in r["terms"])
        assert r["times"] == r["terms"].count(token)


def test_pattern_edge_cases(spark):
    rows = spark.createDataFrame(
        [entry(i, file_name=f"Avengers: Age {i}", file_size=10189 * i, language="English") for i in range(4)],
        ENTRY_SCHEMA,
    ).withColumn("shard_id", F.lit(0))
    found = lambda pattern, **k: p.match(rows, pattern, **k).count()
    assert found(Pattern()) == 0
    assert found(Pattern(file_name="  ")) == 0
    assert found(Pattern(file_name="AVENG")) == 4
    assert found(Pattern(file_name="s: A")) == 4  # "s:" never matches, "a" does
    assert found(Pattern(file_name="rs:")) == 0
    assert found(Pattern(min_size=10189)) == 3
    assert found(Pattern(min_size=0, max_size=10189)) == 2
    assert found(Pattern(description="description1")) == 1
    assert found(Pattern(description="Description1")) == 0
    assert found(Pattern(description="Description1"), fold_case=True) == 1
    scores = {r["entry_id"]: r["score"] for r in score(rows, Pattern(file_name="age 2 zz")).collect()}
    assert scores[2] == pytest.approx(4 / 3) and scores[1] == pytest.approx(1 / 3)


def test_circular_deletes(spark):
    top = p.MIN_LONG + 3
    rows = spark.createDataFrame([(p.MAX_LONG - 2,), (p.MAX_LONG - 1,), (p.MIN_LONG + 1,), (top,)], "id long")
    left = p.delete_low_wrap(rows, p.MIN_LONG + 1, p.MAX_LONG - 2, top)
    assert [r["id"] for r in left.collect()] == [top]
    left = p.delete_high_wrap(rows, p.MAX_LONG - 2, p.MAX_LONG - 2, top)
    assert [r["id"] for r in left.collect()] == [p.MAX_LONG - 2]
    plain = spark.range(10)
    assert p.delete_low_wrap(plain, 4, 0, 9).count() == 5
    assert p.delete_high_wrap(plain, 4, 0, 9).count() == 5


def test_agreement(spark):
    reports = spark.createDataFrame(
        [(0, 0, 1, 10, "COMPLETED"), (1, 0, 1, 10, "COMPLETED"), (0, 1, 1, 5, "ONGOING"), (1, 1, 1, 4, "ONGOING"),
         (0, 2, 1, 7, "COMPLETED"), (1, 2, 1, 6, "COMPLETED")],
        "replica_id int, epoch_id long, leader_id int, num_entries long, status string",
    )
    assert [tuple(r) for r in replicas.common_units(reports, 2).collect()] == [(0, 1, 10)]
    assert [tuple(r) for r in replicas.ongoing_unit_agreed(reports, 2).collect()] == [(1, 1, 4)]
