"""Registered query of language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.language import fold_of, identify, train
from shelfmark.plans.registry import Query


def op2_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = fold_of(F.col("doc_id"))
    model = train(docs.filter(fold != 1).select("lang", "text"))
    return identify(docs, model).select(
        "doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


QUERIES = {"op2_naive_bayes_language": Query(op2_naive_bayes_language)}
