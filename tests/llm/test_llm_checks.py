"""Every query of the subpackage that has SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from shelfmark.llm.registry import llm_queries

QUERIES = llm_queries()


@pytest.fixture(scope="module")
def oracle(small_dir):
    connection = duckdb.connect()
    for file in Path(small_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    yield connection
    connection.close()


def rounded(rows, order):
    return sorted((tuple(round(v, 9) if isinstance(v := r[i], float) else v for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql is not None))
def test_query(spark, small_dir, oracle, name):
    result = QUERIES[name].run(spark, small_dir)
    plan = result._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    answer = oracle.execute(QUERIES[name].sql)
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(result.columns)
    by_name = sorted(range(len(names)), key=names.__getitem__)
    my_order = sorted(range(len(names)), key=result.columns.__getitem__)
    assert rounded(result.collect(), my_order) == rounded(answer.fetchall(), by_name)


def test_registered():
    names = set(__spark_entry__.queries())
    assert names >= set(QUERIES) | {"pipeline"}
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language",
        "near_duplicates",
        "decontamination",
        "personal_data",
        "packing",
    ]


@pytest.mark.parametrize("name", ["op8_prefix_targets", "op10_license_sets"])
def test_native(spark, small_dir, name):
    plan = QUERIES[name].run(spark, small_dir)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "MapInArrow", "Arrow"))
