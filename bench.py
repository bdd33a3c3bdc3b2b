"""Time the headline queries and print one JSON line.

Every query runs twice over the whole tables and the faster run counts; results go
to the no-op sink, so all rows are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.batch_search import search_many
from shelfmark.plans import fixtures as fx
from shelfmark.plans.registry import all_queries
from shelfmark.schema import PATTERN_SCHEMA
from shelfmark.session import local_session

HEADLINE = [
    "search_page",
    "score_hits_description",
    "build_postings",
    "median_id_per_shard",
    "assign_entry_ids_lines",
    "shard_until_fits",
    "percentile_lag",
    "replication_lag",
    "common_hashes",
    "contiguous_prefix",
    "gap_report",
    "rank_peers",
    "ring_assign",
    "stream_replication_lag",
    "stream_dedup_requests",
    "stream_ordered_commit",
]


def search_batch_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hundred patterns: the fixed ones, repeated with other categories and pages."""
    base = fx.patterns(spark).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(5))))
    category = F.element_at(
        F.array(*map(F.lit, ("Video", "Music", "Books", "Default"))), F.col("copy") % 4 + 1
    )
    patterns = base.withColumns(
        {
            "pattern_id": F.col("copy") * 100 + F.col("pattern_id"),
            "category": F.when(F.col("copy") == 0, F.col("category")).otherwise(category),
            "page_from": F.col("page_from") + F.col("copy"),
        }
    )
    names = [f.name for f in PATTERN_SCHEMA.fields]
    return search_many(fx.entries(spark, sf_dir), patterns.orderBy("pattern_id").limit(100).select(*names))


def timed(run: Callable[[SparkSession, str], DataFrame], spark: SparkSession, sf_dir: str) -> float:
    best = float("inf")
    for _ in range(2):
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    folder = tempfile.mkdtemp(prefix="shelfmark-bench-")
    spark = local_session(folder, os.environ.get("BENCH_CPUS", "8"), "shelfmark-bench", "16g")
    registered = all_queries()
    runs = {name: registered[name].run for name in HEADLINE}
    runs["search_batch_100"] = search_batch_100
    seconds = {name: timed(run, spark, sf_dir) for name, run in runs.items()}
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)
    result = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
