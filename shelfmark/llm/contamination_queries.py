"""Registered query of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.contamination import contaminated
from shelfmark.plans.registry import Query


def op4_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


CONTAINMENT_SQL = r"""
WITH shingled AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t-\r]+'), lambda w: w <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 1, item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t-\r]+'), lambda w: w <> '')
  FROM benchmark WHERE item_id IS NOT NULL
), parts AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM shingled
), sizes AS (SELECT id AS item_id, count(*) AS item_shingles FROM parts WHERE kind = 1 GROUP BY 1),
pairs AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared
  FROM parts d JOIN parts i ON d.s = i.s AND d.kind = 0 AND i.kind = 1 GROUP BY 1, 2
)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM pairs JOIN sizes USING (item_id) WHERE shared >= 0.8 * item_shingles
"""

QUERIES = {"op4_containment_search": Query(op4_containment_search, CONTAINMENT_SQL)}
