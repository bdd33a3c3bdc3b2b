"""Registered query of the search for personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.personal_data import KINDS, find_personal_data, told_spans
from shelfmark.plans.registry import Query


def op3_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_personal_data(docs).select(
        "doc_id",
        *[count(kind) for kind in KINDS[:4]],
        F.sha2(told_spans(F.col("base")), 256).alias("base_sha256"),
        told_spans(F.col("spans")).alias("spans"),
    )


QUERIES = {"op3_disclosure_pii": Query(op3_disclosure_pii)}
