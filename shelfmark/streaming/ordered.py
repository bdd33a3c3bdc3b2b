"""Entries are released strictly in id order; what comes too early waits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfmark.functions.ids import unit_literal
from shelfmark.schema import ID, UNIT
from shelfmark.session import durable
from shelfmark.streaming.state import BlockTable, DeltaTable, max_per_key, run_batches, write_batch

FRONTIER_SCHEMA = T.StructType(
    [
        T.StructField("epoch_id", T.LongType()),
        T.StructField("leader_id", T.IntegerType()),
        T.StructField("next_id", T.LongType()),
    ]
)
UNIT_STATE_SCHEMA = T.StructType(
    [
        T.StructField("epoch_id", T.LongType()),
        T.StructField("leader_id", T.IntegerType()),
        T.StructField("num_entries", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("size_seq", T.LongType()),
        T.StructField("pull_status", T.StringType()),
        T.StructField("pull_seq", T.LongType()),
    ]
)
TRACKED_SCHEMA = T.StructType(
    [
        T.StructField("epoch_id", T.LongType()),
        T.StructField("leader_id", T.IntegerType()),
        T.StructField("next_id", T.LongType()),
        T.StructField("num_entries", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("pull_status", T.StringType()),
    ]
)
#: Units of so many epochs in a row are one block of the state.
EPOCHS = 256


def frontier_table(path: str) -> DeltaTable:
    """Per unit the next id that may be released."""
    return DeltaTable(path, FRONTIER_SCHEMA, max_per_key(UNIT, "next_id"))


MASK_SCHEMA = T.StructType(
    [
        T.StructField("epoch_id", T.LongType()),
        T.StructField("leader_id", T.IntegerType()),
        T.StructField("block", T.LongType()),
        T.StructField("mask", T.LongType()),
    ]
)
#: Ids of a unit that one mask tells of.
BITS = 64
#: Waiting entries lie in folders by the hash of their unit.
BUCKETS = 64


def mask_table(path: str) -> DeltaTable:
    """Per unit and block of 64 ids which of them have arrived."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*UNIT, "block").agg(F.bit_or("mask").alias("mask"))

    return DeltaTable(path, MASK_SCHEMA, merge)


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*UNIT), F.lit(BUCKETS)).cast("int")


def _block(value: str) -> Column:
    return F.floor(F.col(value) / F.lit(BITS))


def _bit(value: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({value} & {BITS - 1} as int))")


def unseen(batch: DataFrame, masks: DataFrame, frontier: DataFrame) -> DataFrame:
    """The entries of a batch that have neither been released nor wait: one row for each id."""
    placed = batch.dropDuplicates(ID).withColumn("block", _block("entry_id"))
    known = placed.join(frontier, UNIT, "left").join(masks, [*UNIT, "block"], "left")
    late = F.col("entry_id") < F.coalesce("next_id", F.lit(0))
    there = F.coalesce(F.col("mask").bitwiseAND(_bit("entry_id")) != 0, F.lit(False))
    return known.filter(~late & ~there).select(batch.columns)


def frontiers(masks: DataFrame, units: DataFrame, frontier: DataFrame) -> DataFrame:
    """(unit, start, next_id) of the units: where they stand, and the first id from there on that
    has not arrived.

    The first block that is not full is found by an anti-join, and the id within its mask. Units
    advance independently, so a shard is never one task, nor is a unit.
    """
    start = units.join(frontier, UNIT, "left").select(*UNIT, F.coalesce("next_id", F.lit(0)).alias("start"))
    blocks = masks.join(start, UNIT).filter(F.col("block") >= _block("start"))
    # What lies below the frontier counts as there.
    ones = F.expr(f"CASE WHEN start & {BITS - 1} = 0 THEN 0L ELSE shiftrightunsigned(-1L, {BITS} - cast(start & {BITS - 1} AS int)) END")
    below = F.when(F.col("block") == _block("start"), ones).otherwise(F.lit(0).cast("long"))
    blocks = durable(blocks.select(*UNIT, "start", "block", F.col("mask").bitwiseOR(below).alias("mask")))
    full = blocks.filter(F.col("mask") == -1)
    ahead = full.select(*UNIT, "start", (F.col("block") + 1).alias("block"))
    ahead = ahead.unionByName(start.withColumn("block", _block("start")))
    first = ahead.join(full.select(*UNIT, "block"), [*UNIT, "block"], "left_anti")
    first = first.groupBy(*UNIT, "start").agg(F.min("block").alias("block"))
    mask = F.coalesce("mask", F.lit(0).cast("long"))
    missing = F.array_min(
        F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit(mask, i) == 0)
    )
    found = first.join(blocks.select(*UNIT, "block", "mask"), [*UNIT, "block"], "left")
    at = F.greatest(F.col("start"), F.col("block") * BITS + missing)
    return found.select(*UNIT, "start", at.cast("long").alias("next_id"))


def stream_ordered_commit(
    stream: DataFrame, path: str, state_path: str, checkpoint: str
) -> StreamingQuery:
    """Release the entries of a stream in id order, batch after batch.

    Ids below the frontier of their unit are dropped, as are repeats. ``path`` gets two folders
    per batch: the entries that it released, and those of its own that wait. A waiting entry is
    written once, and read again when its unit advances; the state holds the frontier of each
    unit and one mask for 64 ids that are there. So a batch writes in proportion to itself and
    to what it releases, however many entries wait. Ids that are lost for ever keep their
    successors waiting; ``stalled`` reports them.
    """
    frontier, masks = frontier_table(f"{state_path}/frontier"), mask_table(f"{state_path}/masks")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = frontier.before(spark, batch_id)

        def ahead(rows: DataFrame) -> DataFrame:
            """Masks of blocks that the frontier has not passed."""
            placed = rows.join(known, UNIT, "left")
            return placed.filter(F.col("block") >= F.floor(F.coalesce("next_id", F.lit(0)) / BITS)).select(rows.columns)

        units = durable(batch.select(*UNIT).distinct())
        held_masks = durable(masks.before(spark, batch_id, ahead).join(units, UNIT, "left_semi"))
        fresh = durable(unseen(batch, held_masks, known))
        delta = fresh.groupBy(*UNIT, _block("entry_id").alias("block")).agg(F.bit_or(_bit("entry_id")).alias("mask"))
        masks.add(delta, batch_id)
        now = masks.merge(held_masks.unionByName(delta))
        # Needed for the rows and for the state, so it is computed once.
        bounds = durable(frontiers(now, units, known))
        frontier.add(bounds, batch_id)
        passed = (F.col("entry_id") >= F.col("start")) & (F.col("entry_id") < F.col("next_id"))
        rows = fresh
        advanced = bounds.filter(F.col("next_id") > F.col("start"))
        if batch_id > 0 and not advanced.isEmpty():
            buckets = [r[0] for r in advanced.select(_bucket()).distinct().collect()]
            earlier = _waiting(spark, path, batch.schema, batch_id)
            rows = rows.unionByName(earlier.filter(F.col("bucket").isin(buckets)).drop("bucket"))
        released_rows = rows.join(advanced, UNIT).filter(passed).select(batch.columns)
        released_rows.write.mode("overwrite").parquet(f"{path}/released/batch={batch_id}")
        waits = fresh.join(bounds, UNIT).filter(F.col("entry_id") >= F.col("next_id")).select(batch.columns)
        waits.withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(
            f"{path}/waiting/batch={batch_id}"
        )

    return run_batches(stream, each, checkpoint)


def _waiting(spark: SparkSession, path: str, schema: T.StructType, batches: int) -> DataFrame:
    """What the first ``batches`` batches had to let wait, with its bucket."""
    placed = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    names = [f.name for f in placed.fields]
    folders = [f"{path}/waiting/batch={b}" for b in range(batches)]
    tables = [spark.read.schema(placed).parquet(f).select(names) for f in folders]
    if not tables:
        return spark.createDataFrame([], placed)
    return reduce(DataFrame.unionByName, tables)


def released(spark: SparkSession, path: str) -> DataFrame:
    """All entries released so far, with the batch that released them."""
    return spark.read.parquet(f"{path}/released")


def held(spark: SparkSession, path: str, state_path: str, schema: T.StructType, batches: int) -> DataFrame:
    """The entries that wait after the first ``batches`` batches."""
    rows = _waiting(spark, path, schema, batches).drop("bucket")
    left = rows.join(committed(spark, state_path, batches), UNIT, "left")
    return left.filter(F.col("entry_id") >= F.coalesce("next_id", F.lit(0))).select(rows.columns)


def committed(spark: SparkSession, state_path: str, batches: int) -> DataFrame:
    """The frontier after the first ``batches`` batches."""
    return frontier_table(f"{state_path}/frontier").before(spark, batches)


def stalled(waiting: DataFrame, frontier: DataFrame) -> DataFrame:
    """Units that wait: the missing id and the range that is held back behind it."""
    ranges = waiting.groupBy(*UNIT).agg(
        F.min("entry_id").alias("held_from"),
        F.max("entry_id").alias("held_to"),
        F.count(F.lit(1)).alias("held"),
    )
    return ranges.join(frontier, UNIT, "left").withColumn(
        "next_id", F.coalesce("next_id", F.lit(0))
    )


def _merged_reports(rows: DataFrame) -> DataFrame:
    """As ``latest_unit``, with the numbers of the reports that were taken, so it can be repeated."""
    size = F.struct("num_entries", "status", "size_seq")
    return rows.groupBy(*UNIT).agg(
        F.max_by(size, F.struct("num_entries", "size_seq")).alias("s"),
        F.min_by(F.struct("pull_status", "pull_seq"), F.col("pull_seq")).alias("p"),
    ).select(*UNIT, "s.*", "p.*")


def _judged(units: DataFrame, frontier: DataFrame, first: int, last: int) -> DataFrame:
    """Units of a range of epochs with their next id, and whether they are left behind."""
    here = frontier.filter(F.col("epoch_id").between(first, last)).select(*UNIT, "next_id")
    joined = units.filter(F.col("epoch_id").between(first, last)).join(here, UNIT, "left")
    known = joined.withColumn("next_id", F.coalesce("next_id", F.lit(0)).cast("long"))
    whole = (F.col("status") == "COMPLETED") & (F.col("next_id") >= F.col("num_entries"))
    done = (F.col("pull_status") == "SKIP") | whole
    return known.withColumn("done", done)


def _least_open() -> Column:
    row = F.struct(*(f.name for f in TRACKED_SCHEMA.fields))
    return F.min(F.when(~F.col("done"), row)).alias("open")


def _walk(units: BlockTable, frontier: DataFrame, spark: SparkSession, batches: int, at: Row | None) -> Row | None:
    """The first unit from ``at`` on that is not left behind, or the last one before a missing epoch.

    Blocks are read from that of ``at`` on, twice as many each time while all units in them are
    left behind: a walk reads in proportion to what it passes, in few steps.
    """
    expected = at["epoch_id"] if at else 0
    block, width, last = expected // EPOCHS, 1, None
    while True:
        end = (block + width) * EPOCHS - 1
        here = units.before(spark, range(block, block + width), batches)
        if at and last is None:
            here = here.filter(F.struct(*UNIT) >= unit_literal(at["epoch_id"], at["leader_id"]))
        here = here.filter(F.col("epoch_id").between(expected, end))
        before = here.select((F.col("epoch_id") - 1).alias("epoch_id"))
        run = here.select("epoch_id").join(before, "epoch_id", "left_anti").agg(F.min("epoch_id")).scalar()
        row = F.struct(*(f.name for f in TRACKED_SCHEMA.fields))
        found = (
            _judged(here, frontier, expected, end)
            .filter(F.col("epoch_id") <= run)
            .agg(_least_open(), F.max(row).alias("last"), F.min("epoch_id").alias("first"))
            .first()
        )
        if found["first"] != expected:
            return last
        if found["open"]:
            return found["open"]
        last = found["last"]
        if last["epoch_id"] < end:
            return last
        expected, block, width = end + 1, block + width, 2 * width


def stream_unit_advance(
    units: DataFrame, frontier: DataFrame, path: str, state_path: str, checkpoint: str
) -> StreamingQuery:
    """Follow the unit that is being pulled while unit reports arrive.

    Reports (with an arrival number ``seq``) are merged as ``latest_unit`` does, in any order of
    arrival; units before epoch 0 are never tracked and not kept. After each batch the tracked
    unit is written. It is a pointer that moves: all safe units before it are left behind, so
    only those that the batch reports can call it back, and otherwise it walks on from where it
    stands. A batch reads and writes the blocks of epochs that it reports or that the pointer
    passes. Next ids of the frontier may grow between batches, not shrink.
    """
    table = BlockTable(state_path, UNIT_STATE_SCHEMA)
    block = F.floor(F.col("epoch_id") / EPOCHS).cast("long")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        reports = durable(
            batch.filter(F.col("epoch_id") >= 0).select(
                *UNIT, "num_entries", "status", F.col("seq").alias("size_seq"), "pull_status", F.col("seq").alias("pull_seq")
            )
        )
        blocks = [r[0] for r in reports.select(block).distinct().collect()]
        at = None
        if batch_id > 0:
            at = spark.read.schema(TRACKED_SCHEMA).parquet(f"{path}/batch={batch_id - 1}").first()
        if blocks:
            before = table.before(spark, blocks, batch_id)
            table.write(_merged_reports(before.unionByName(reports)), block, blocks, batch_id)
            if at:
                told = table.before(spark, blocks, batch_id + 1).join(reports.select(*UNIT).distinct(), UNIT, "left_semi")
                behind = _judged(told, frontier, min(blocks) * EPOCHS, at["epoch_id"])
                behind = behind.filter(F.struct(*UNIT) < unit_literal(at["epoch_id"], at["leader_id"]))
                at = behind.agg(_least_open()).first()[0] or at
        at = _walk(table, frontier, spark, batch_id + 1, at)
        write_batch(spark.createDataFrame([at] if at else [], TRACKED_SCHEMA), path, batch_id)

    return run_batches(units, each, checkpoint)
