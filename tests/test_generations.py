"""Versions of stores: seen whole or not at all, also beside other writers and after failures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfmark.schema import ENTRY_SCHEMA, ID
from shelfmark.session import work_dir
from shelfmark.sources import catalog, generations


def rows(spark, ids, category=lambda i: ("Video", "Music")[i % 2]):
    names = [f.name for f in ENTRY_SCHEMA.fields]
    full = [{"epoch_id": i // 10, "leader_id": 1, "entry_id": i % 10, "category": category(i), "file_name": f"f{i}", "file_size": i} for i in ids]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], ENTRY_SCHEMA)


def sizes(spark, path, **options):
    return sorted(r[0] for r in catalog.read_entries(spark, path, **options).select("file_size").collect())


def test_versions_stay_as_they_were(spark):
    path = work_dir(spark, "store")
    catalog.append_entries(rows(spark, range(20)), path)
    first = catalog.read_entries(spark, path).select("file_size")
    catalog.append_entries(rows(spark, range(20, 30)), path)
    catalog.delete_entries(spark, path, F.col("file_size") < 5)
    assert sizes(spark, path) == list(range(5, 30))
    # A reader that began before keeps its version; older ones can be asked for.
    assert first.count() == 20
    assert sizes(spark, path, number=2) == list(range(30))
    catalog.truncate(spark, path)
    assert sizes(spark, path) == []
    catalog.append_entries(rows(spark, [7]), path)
    assert sizes(spark, path) == [7]


def test_a_write_that_ends_half_way_is_not_seen(spark, monkeypatch):
    path = work_dir(spark, "store")
    catalog.append_entries(rows(spark, range(20)), path)

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(generations, "commit", fails)
        with pytest.raises(OSError):
            catalog.append_entries(rows(spark, range(20, 40)), path)
        with pytest.raises(OSError):
            catalog.delete_entries(spark, path, F.col("category") == "Music")
    broken = rows(spark, range(50, 90)).withColumn("file_name", F.expr("CASE WHEN file_size = 88 THEN raise_error('lost') ELSE file_name END"))
    with pytest.raises(Exception, match="lost"):
        catalog.append_entries(broken, path)
    assert sizes(spark, path) == list(range(20))
    assert generations.version(spark, path).number == 1
    # What those writers left is in no version, and goes.
    assert len(generations.vacuum(spark, path)) >= 2
    assert sizes(spark, path) == list(range(20))


def test_only_one_writer_makes_a_version(spark):
    path = work_dir(spark, "store")
    catalog.append_entries(rows(spark, range(10)), path)
    base = generations.version(spark, path)
    generations.commit(spark, path, base, list(base.parts))
    with pytest.raises(generations.Conflict):
        generations.commit(spark, path, base, [])
    assert sizes(spark, path) == list(range(10))
    # An addition is tried again on top of the other writer's version.
    seen = []

    def parts(held):
        if not seen:
            generations.commit(spark, path, held, list(held.parts))
        seen.append(held.number)
        return list(held.parts)

    assert generations.change(spark, path, parts).number == 4
    assert seen == [2, 3]


def test_deletion_writes_only_pieces_that_lose_rows(spark):
    path = work_dir(spark, "store")
    catalog.append_entries(rows(spark, range(20)), path)
    catalog.append_entries(rows(spark, range(20, 40)), path)
    before = generations.version(spark, path).parts
    catalog.delete_entries(spark, path, (F.col("category") == "Music") & (F.col("file_size") > 30))
    after = generations.version(spark, path).parts
    assert after[0] == before[0]
    assert after[1]["pieces"] == ["category=Video"] and after[2]["pieces"] == ["category=Music"]
    assert sizes(spark, path) == [i for i in range(40) if not (i % 2 and i > 30)]
    catalog.delete_entries(spark, path, F.col("file_size") > 1000)
    assert generations.version(spark, path).number == 3


def test_odd_categories_and_repeated_ids(spark):
    path = work_dir(spark, "store")
    names = ["a/b", "x=y", "é %", "Video"]
    some = rows(spark, [1, 1, 2, 3, 4, 5], lambda i: names[i % 4])
    catalog.append_entries(some, path)
    catalog.delete_entries(spark, path, (F.col("category") == "x=y") & (F.col("file_size") == 5))
    got = catalog.read_entries(spark, path).select("category", "file_size", *ID).collect()
    assert sorted((r[0], r[1]) for r in got) == sorted((names[i % 4], i) for i in [1, 1, 2, 3, 4])


def test_compaction(spark):
    path = work_dir(spark, "store")
    for i in range(5):
        catalog.append_entries(rows(spark, range(10 * i, 10 * i + 10)), path)
    assert not catalog.compact_entries(spark, path, 5)
    assert catalog.compact_entries(spark, path, 4)
    assert len(generations.version(spark, path).parts) == 1
    assert sizes(spark, path) == list(range(50))
    generations.vacuum(spark, path, keep=1)
    assert sizes(spark, path) == list(range(50))


def test_plain_folders_are_read(spark):
    path = work_dir(spark, "plain")
    rows(spark, range(6)).write.partitionBy("category").parquet(path)
    assert sizes(spark, path) == list(range(6))
