"""Replies of search rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.schema import QUERY_TIMEOUT_SECONDS


def stream_first_reply(
    replies: DataFrame,
    life: str = f"{QUERY_TIMEOUT_SECONDS} seconds",
    delay: str = f"{QUERY_TIMEOUT_SECONDS} seconds",
) -> DataFrame:
    """The earliest reply of each (round, shard), once the watermark has passed the round.

    Rounds lie in windows of ``life``. A minimum per window, round and shard is all the state,
    however the replies are dealt to batches; a reply that comes more than ``delay`` late is
    ignored.
    """
    rest = [c for c in replies.columns if c not in ("round_id", "shard_id", "ts")]
    # Only the window may be an event time, so the time of the reply is a number inside.
    reply = F.struct(F.unix_micros("ts").alias("at"), *rest)
    firsts = (
        replies.withWatermark("ts", delay)
        .groupBy(F.window("ts", life), "round_id", "shard_id")
        .agg(F.min(reply).alias("_f"))
    )
    return firsts.select(
        "round_id", "shard_id", F.timestamp_micros("_f.at").alias("ts"), *(F.col(f"_f.{c}") for c in rest)
    )


def reply_interval_join(
    queries: DataFrame,
    replies: DataFrame,
    timeout: str = f"{QUERY_TIMEOUT_SECONDS} seconds",
    how: str = "inner",
    salts: int = 1,
) -> DataFrame:
    """Replies of the right round that arrive within the timeout.

    Works on tables and on streams. Columns: queries (round_id, query_ts), replies
    (round_id, shard_id, ts). On tables adaptive execution splits a round with many replies.
    Stream joins have no such split: ``salts`` spreads the replies of a round over so many
    parts and repeats the one row of its query for each; with an outer join an unanswered
    query therefore appears once per part.
    """
    q, r = queries.alias("q"), replies.alias("r")
    same_round = F.col("q.round_id") == F.col("r.round_id")
    if salts > 1:
        parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        spread = F.pmod(F.xxhash64("shard_id", "ts"), F.lit(salts)).cast("int")
        q = queries.withColumn("_salt", parts).alias("q")
        r = replies.withColumn("_salt", spread).alias("r")
        same_round = same_round & (F.col("q._salt") == F.col("r._salt"))
    in_time = F.expr(f"r.ts >= q.query_ts AND r.ts <= q.query_ts + INTERVAL {timeout}")
    joined = q.join(r, same_round & in_time, how)
    return joined.select(
        *(F.col(f"q.{c}") for c in queries.columns),
        *(F.col(f"r.{c}") for c in replies.columns if c != "round_id"),
    )


def stream_reply_join(
    queries: DataFrame,
    replies: DataFrame,
    timeout: str = f"{QUERY_TIMEOUT_SECONDS} seconds",
    delay: str = f"{QUERY_TIMEOUT_SECONDS} seconds",
    salts: int = 8,
) -> DataFrame:
    """The interval join with watermarks on both sides, so state is bounded by the timeout.

    ``salts`` is the number of parts of a round: as many as the largest round needs tasks.
    """
    return reply_interval_join(
        queries.withWatermark("query_ts", delay),
        replies.withWatermark("ts", delay),
        timeout,
        salts=salts,
    )


def stream_round_timeout(
    queries: DataFrame,
    replies: DataFrame,
    timeout: str = f"{QUERY_TIMEOUT_SECONDS} seconds",
    delay: str = f"{QUERY_TIMEOUT_SECONDS} seconds",
    salts: int = 8,
) -> DataFrame:
    """One row per round at its timeout: complete with its replies, or empty.

    A round is complete when as many shards as ``expected`` replied in time; what an
    incomplete round did get is thrown away. The set of shards is bounded by the
    number of shards.
    """
    in_time = reply_interval_join(
        queries.withWatermark("query_ts", delay),
        replies.withWatermark("ts", delay),
        timeout,
        "left_outer",
        salts,
    )
    # Only the window may be an event time, so the start of the round is a number here.
    opened = F.unix_micros("query_ts").alias("opened")
    rounds = in_time.groupBy(F.window("query_ts", timeout), "round_id", opened, "expected").agg(
        F.size(F.collect_set("shard_id")).alias("replied"), F.count("shard_id").alias("hits")
    )
    complete = (F.col("expected") != 0) & (F.col("replied") >= F.col("expected"))
    return rounds.select(
        "round_id",
        F.timestamp_micros("opened").alias("query_ts"),
        complete.alias("complete"),
        F.when(complete, F.col("hits")).otherwise(0).alias("hits"),
    )
