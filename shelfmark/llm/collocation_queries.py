"""Registered query of phrase collocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.collocations import collocations
from shelfmark.plans.registry import Query


def op11_fm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces
), totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM split GROUP BY lang),
lengths AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
places AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM split, lengths WHERE len(ws) >= k),
grams AS MATERIALIZED (
  SELECT lang, k, ws[i:i + k - 1] AS words, CAST(count(*) AS BIGINT) AS a FROM places GROUP BY ALL HAVING count(*) >= 100
), candidates AS (SELECT * FROM grams WHERE k > 1),
inner_parts AS (
  SELECT c.lang, c.words[p.i:p.i + p.k - 1] AS words, max(c.a) AS around
  FROM candidates c JOIN (SELECT k, i FROM (VALUES (2), (3), (4)) t(k), (VALUES (1), (2), (3), (4)) s(i)) p
    ON p.k < c.k AND p.i + p.k - 1 <= c.k
  GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_parts p USING (lang, words)
  WHERE p.around IS NULL OR 100 * p.around < 100 * c.a
), cuts AS (
  SELECT c.lang, c.words, c.a, t.n, x.j, l.a AS l, r.a AS r,
    CAST((1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM kept c JOIN (VALUES (1), (2), (3), (4)) x(j) ON x.j < c.k JOIN totals t USING (lang)
  JOIN grams l ON l.lang = c.lang AND l.words = c.words[1:x.j]
  JOIN grams r ON r.lang = c.lang AND r.words = c.words[x.j + 1:c.k]
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, j) AS cut FROM cuts
), ranked AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank
  FROM best WHERE cut = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

QUERIES = {"op11_fm_collocations": Query(op11_fm_collocations, COLLOCATIONS_SQL)}
