"""Registered query of substring dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.repeats import remove_repeats
from shelfmark.plans.registry import Query


def op6_fixed_block_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


REPEAT_SQL = r"""
WITH listed AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS w FROM documents
), starts AS (
  SELECT r, doc_id, unnest(range(len(w) - 12)) AS i, unnest(list_transform(range(len(w) - 12), lambda i: array_to_string(w[i + 1:i + 13], ' '))) AS s
  FROM listed
), least AS (SELECT s, min(doc_id) AS d FROM starts GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT r, list(DISTINCT p) AS places FROM (
    SELECT r, unnest(range(i, i + 13)) AS p FROM starts JOIN least USING (s) WHERE d < doc_id
  ) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: places IS NULL OR NOT list_contains(places, i - 1)), ' ')) AS kept_sha256
FROM listed LEFT JOIN gone USING (r)
"""

QUERIES = {"op6_fixed_block_repeats": Query(op6_fixed_block_repeats, REPEAT_SQL)}
