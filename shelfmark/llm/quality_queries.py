"""Registered query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.quality import quality
from shelfmark.plans.registry import Query


def op5_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op5_weak_label_quality": Query(op5_weak_label_quality)}
