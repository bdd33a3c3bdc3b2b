"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from shelfmark.plans.registry import all_queries

QUERIES = all_queries()


@pytest.fixture(scope="module")
def oracle(small_dir):
    connection = duckdb.connect()
    for file in Path(small_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    yield connection
    connection.close()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def sorted_rows(rows, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small_dir, oracle, name):
    query = QUERIES[name]
    result = query.run(spark, small_dir)
    plan = result._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    columns = result.columns
    mine = result.collect()
    if query.sql is None:
        assert mine
        return
    answer = oracle.execute(query.sql)
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(columns)
    by_name = sorted(range(len(names)), key=names.__getitem__)
    my_order = sorted(range(len(columns)), key=columns.__getitem__)
    assert sorted_rows(mine, my_order) == sorted_rows(answer.fetchall(), by_name)
