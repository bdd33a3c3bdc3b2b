"""Registered query of the packing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.packing import pack
from shelfmark.llm.vocabulary import tokenizer_path
from shelfmark.plans.registry import Query


def op9_pack_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer_path()).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").cast("long").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


QUERIES = {"op9_pack_first_fit": Query(op9_pack_first_fit)}
