"""Registered query of the license scan."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, _plain_words, scan_licenses
from shelfmark.plans.registry import Query


def op10_license_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_union(F.transform("places", lambda p: p["label"]), "template_labels"))
    words = F.transform("places", lambda p: p["word"])
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.col("containment")).alias("score"),
    )


def _sql() -> str:
    def listed(words) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    places = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(len(words) - {len(p.split()) - 1}), "
        + "lambda i: "
        + " AND ".join(f"words[i + {j + 1}] = '{w}'" for j, w in enumerate(p.split()))
        + ")) AS word FROM lists"
        for p, label in PHRASES.items()
    )
    rows = []
    for label, text in TEMPLATES:
        tokens = sorted(set(_plain_words(text)))
        rows.append(f"('{label}', {listed(tokens)}, {math.ceil(CONTAINMENT * len(tokens) - 1e-9)})")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = r"list_filter(string_split_regex({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    return f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS low FROM documents),
lists AS (SELECT doc_id, {cut.format("low")} AS words FROM low),
places AS ({places}),
blocks AS (SELECT doc_id, list_distinct({cut.format("line")}) AS tokens
  FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS line FROM low)),
templates(label, tokens, need) AS (VALUES {", ".join(rows)}),
near AS (
  SELECT doc_id, label, len(list_intersect(b.tokens, t.tokens)) / len(t.tokens) AS share
  FROM blocks b JOIN templates t ON len(list_intersect(b.tokens, t.tokens)) >= t.need
),
base AS (SELECT doc_id, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY 1),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM near) GROUP BY 1),
best AS (SELECT doc_id, max(share) AS share FROM near GROUP BY 1)
SELECT l.doc_id, CAST(len(l.words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM lists l LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)
"""


QUERIES = {"op10_license_sets": Query(op10_license_sets, _sql())}
