"""Registered query of the whitening of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.whitening import whiten
from shelfmark.plans.registry import Query


def op13_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES = {"op13_exact_whitening": Query(op13_exact_whitening)}
