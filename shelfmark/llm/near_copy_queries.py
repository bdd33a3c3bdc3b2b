"""Registered query of near-duplicate detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.near_copies import near_copies
from shelfmark.plans.registry import Query


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op1_order_minhash": Query(op1_order_minhash)}
