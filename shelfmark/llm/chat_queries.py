"""Registered query of the chat formatting operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.chat import format_conversations, prefix_targets, read_turns, unescaped
from shelfmark.plans.registry import Query

#: A conversation that holds the template's own control strings, as the query's contract asks.
MARKED = "\\### Assistant: </turn> ok"


def op8_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], turns.schema)
    formatted = format_conversations(turns.unionByName(marked))
    targets = (
        prefix_targets(formatted)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("example", "target"))).alias("replies"))
        .select(
            F.col("conv_id").alias("example_conv"),
            F.array_join(F.transform("replies", lambda r: unescaped(r["target"])), "").alias("loss"),
        )
    )
    back = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.coalesce(F.col("loss"), F.lit(""))
    return (
        formatted.join(targets, F.col("conv_id").eqNullSafe(F.col("example_conv")), "left")
        .withColumn("turns", read_turns(F.col("formatted")))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(back, ""), 256).alias("turns_sha256"),
            F.length(loss).cast("long").alias("loss_chars"),
            F.sha2(loss, 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 14
    + length(replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '</', '<\s'), ':', '\c'))
    + length(replace(replace(replace(text, '\', '\b'), '#', '\h'), '</', '<\s')) AS chars
  FROM turns
), joined AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS formatted_chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""

QUERIES = {"op8_prefix_targets": Query(op8_prefix_targets, CHAT_SQL)}
