"""Requests seen within the last minutes are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.ordering import following
from shelfmark.schema import REQUEST_TTL_SECONDS
from shelfmark.session import durable
from shelfmark.streaming.state import DeltaTable, max_per_key, run_batches, write_batch

# Rounds before long runs of one id are followed by doubling.
DIRECT_ROUNDS = 3
SEEN_SCHEMA = T.StructType(
    [T.StructField("request_id", T.StringType()), T.StructField("seen", T.LongType())]
)
MARK_SCHEMA = "mark long"


def _bucket(at: Column, ttl: int) -> Column:
    return F.floor(at / F.lit(ttl))


def _openers(rows: DataFrame, ttl: int) -> DataFrame:
    """Rows with no other undecided row of their request in the ``ttl`` before them.

    Time is cut into buckets of ``ttl``: only the first row of a bucket can be one,
    and only the last row of the bucket before can prevent it. Both are plain
    minima and maxima, so a request id that makes up a third of all rows is
    combined before the shuffle.
    """
    buckets = rows.groupBy("request_id", "_bucket").agg(
        F.min(F.struct("_at", "event_id")).alias("_first"), F.max("_at").alias("_last")
    )
    before = buckets.select(
        "request_id", (F.col("_bucket") + 1).alias("_bucket"), F.col("_last").alias("_prior")
    )
    free = F.col("_prior").isNull() | (F.col("_first._at") - F.col("_prior") > ttl)
    return (
        buckets.join(before, ["request_id", "_bucket"], "left")
        .filter(free)
        .select("request_id", "_bucket", "_first._at", "_first.event_id")
    )


def _reached(rows: DataFrame, opened: DataFrame, ttl: int) -> DataFrame:
    """Everything the openers lead to: each accepted time points to the next one.

    The pointer of a time is the first time more than ``ttl`` after it. Pointers are
    followed by doubling, so a run of n acceptances takes log2(n) rounds.
    """
    points = rows.groupBy("request_id", "_at").agg(F.min("event_id").alias("event_id"))
    probes = points.select("request_id", (F.col("_at") + ttl).alias("_key"), F.lit(None).cast("long").alias("_hit"))
    marks = points.select("request_id", F.col("_at").alias("_key"), F.col("_at").alias("_hit"))
    keys = probes.withColumn("_probe", F.lit(True)).unionByName(marks.withColumn("_probe", F.lit(False)))
    keys = keys.groupBy("request_id", "_key").agg(F.max("_hit").alias("_hit"), F.bool_or("_probe").alias("_probe"))
    pointed = following(keys, ["request_id"], "_key", F.col("_hit"), "_next")
    jump = durable(
        pointed.filter(F.col("_probe") & F.col("_next").isNotNull()).select(
            "request_id", (F.col("_key") - ttl).alias("_at"), "_next"
        )
    )
    reached, size = durable(opened.select("request_id", "_at")), 0
    while (grown := reached.count()) > size:
        size = grown
        ahead = reached.join(jump, ["request_id", "_at"]).select("request_id", F.col("_next").alias("_at"))
        reached = durable(reached.union(ahead).distinct())
        further = jump.select("request_id", F.col("_at").alias("_next"), F.col("_next").alias("_then"))
        jump = durable(
            jump.join(further, ["request_id", "_next"]).select("request_id", "_at", F.col("_then").alias("_next"))
        )
    return points.join(reached, ["request_id", "_at"]).select("request_id", "_at", "event_id")


def _uncovered(rows: DataFrame, opened: DataFrame, ttl: int) -> DataFrame:
    """Rows that no accepted row covers."""
    covers = opened.select(
        "request_id",
        F.col("_at").alias("_from"),
        F.explode(F.array(F.col("_bucket"), F.col("_bucket") + 1)).alias("_bucket"),
    )
    # A bucket can be reached by an acceptance of its own and one of the bucket before.
    covers = covers.groupBy("request_id", "_bucket").agg(
        F.min("_from").alias("_early"), F.max("_from").alias("_late")
    )

    def covered(start: str) -> Column:
        return F.coalesce(F.col("_at").between(F.col(start), F.col(start) + ttl), F.lit(False))

    return (
        rows.join(covers, ["request_id", "_bucket"], "left")
        .filter(~covered("_early") & ~covered("_late"))
        .drop("_early", "_late")
    )


def accept_requests(
    requests: DataFrame, seen: DataFrame | None = None, ttl_seconds: int = REQUEST_TTL_SECONDS
) -> DataFrame:
    """Requests whose id was not accepted within the ``ttl_seconds`` before them.

    Columns: request_id, ts, event_id. ``seen`` holds ids accepted earlier with their
    time in microseconds. A round accepts every row that no undecided row can block
    and drops what those rows cover; a micro-batch needs one or two. Ids that are
    asked for without a pause over a long time are finished by ``_reached``.
    """
    ttl = ttl_seconds * 1_000_000
    at = F.unix_micros("ts")
    rows = requests.select("request_id", "event_id", at.alias("_at"), _bucket(at, ttl).alias("_bucket"))
    if seen is not None:
        fresh = F.col("seen").isNull() | (F.col("_at") - F.col("seen") > ttl)
        rows = rows.join(seen, "request_id", "left").filter(fresh).drop("seen")
    undecided = durable(rows)
    accepted = undecided.limit(0).select("request_id", "_at", "event_id")
    for direct in range(DIRECT_ROUNDS + 1):
        if undecided.isEmpty():
            break
        opened = durable(_openers(undecided, ttl))
        if direct == DIRECT_ROUNDS:
            accepted = accepted.unionByName(_reached(undecided, opened, ttl))
            break
        accepted = accepted.unionByName(opened.drop("_bucket"))
        undecided = durable(_uncovered(undecided, opened, ttl))
    return accepted.select("request_id", "event_id", F.timestamp_micros("_at").alias("ts"))


def stream_dedup_requests(
    stream: DataFrame,
    path: str,
    state_path: str,
    checkpoint: str,
    ttl_seconds: int = REQUEST_TTL_SECONDS,
    delay_seconds: int = 0,
) -> StreamingQuery:
    """The same on a stream whose requests arrive at most ``delay_seconds`` behind later ones.

    A request is judged when no earlier one can come any more: until the latest time seen is
    ``delay_seconds`` past it, it is held. So requests dealt to batches in any order within the
    delay are judged as in one table. A request that comes later than that is not judged; it is
    put aside (see ``late_requests``). What is held at the end of a stream stays held until a
    later time is seen.
    """
    seen = DeltaTable(f"{state_path}/seen", SEEN_SCHEMA, max_per_key(["request_id"], "seen"))
    delay = delay_seconds * 1_000_000

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, at = batch.sparkSession, F.unix_micros("ts")
        before = None
        rows = batch
        if batch_id > 0:
            last = spark.read.schema(MARK_SCHEMA).parquet(f"{state_path}/mark/batch={batch_id - 1}")
            before = last.first()[0]
            rows = spark.read.schema(batch.schema).parquet(f"{state_path}/held/batch={batch_id - 1}").unionByName(
                batch if before is None else batch.filter(at >= before - delay)
            )
        newest = [t for t in (before, batch.agg(F.max(at)).first()[0]) if t is not None]
        mark = max(newest, default=None)
        spark.createDataFrame([(mark,)], MARK_SCHEMA).write.mode("overwrite").parquet(f"{state_path}/mark/batch={batch_id}")
        late = batch.limit(0) if before is None else batch.filter(at < before - delay)
        late.write.mode("overwrite").parquet(f"{state_path}/late/batch={batch_id}")
        ripe = F.lit(False) if mark is None else at <= mark - delay
        rows.filter(~ripe).write.mode("overwrite").parquet(f"{state_path}/held/batch={batch_id}")
        ready = rows.filter(ripe)
        # Ids that can no longer block anything from here on are left out, and are not carried
        # into the next snapshot either: what is judged later is no earlier than the last mark.
        start = None if before is None else before - delay
        lives = None if start is None else F.col("seen") >= start - ttl_seconds * 1_000_000
        known = seen.before(spark, batch_id, lives)
        stored = write_batch(accept_requests(ready, known, ttl_seconds), path, batch_id)
        delta = stored.groupBy("request_id").agg(F.max(F.unix_micros("ts")).alias("seen"))
        seen.add(delta, batch_id)

    return run_batches(stream, each, checkpoint)


def late_requests(spark: SparkSession, state_path: str) -> DataFrame:
    """Requests that came too late to be judged, with their batch."""
    return spark.read.parquet(f"{state_path}/late")


def native_dedup(stream: DataFrame, keys: list[str], delay: str = "5 minutes") -> DataFrame:
    """Spark's own form: the first row of each key while its state lives.

    The state outlives the delay by the watermark lag, so it drops at least what
    ``stream_dedup_requests`` drops, and sometimes more.
    """
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
