"""Streams in many batches, restarts, and their batch twins."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from shelfmark.operators.units import lowest_missing
from shelfmark.schema import UNIT
from shelfmark.session import work_dir
from shelfmark.sources import dumps
from shelfmark.streaming import ordered, requests, state, telemetry
from tests_support import greedy, stream_of

RNG = random.Random(11)


def test_requests_over_many_batches(spark):
    rows = [
        ("hot" if RNG.random() < 0.4 else f"r{RNG.randrange(20)}", RNG.randrange(3000) * 1_000_000, e)
        for e in range(1200)
    ]
    rows.sort(key=lambda r: (r[1], r[2]))
    schema = "request_id string, at long, event_id long"
    parts = [rows[i : i + 300] for i in range(0, 1200, 300)]
    stream = stream_of(spark, parts, schema).withColumn("ts", F.timestamp_micros("at"))
    path = work_dir(spark, "out")
    requests.stream_dedup_requests(
        stream, path, work_dir(spark, "state"), work_dir(spark, "ckpt")
    ).awaitTermination()
    got = [r["event_id"] for r in state.read_batches(spark, path).collect()]
    kept = greedy(rows, 300_000_000)
    assert sorted(got) == sorted(kept) and len(kept) < len(rows)


def test_requests_out_of_order(spark):
    """Requests dealt to batches at random within the delay give what one table gives; those that
    come later than that are put aside."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else f"r{rng.randrange(9)}", rng.randrange(3000) * 1_000_000, e) for e in range(500)]
    # Arrival by time plus up to 400 seconds: no request is more than that behind a later one.
    arriving = sorted(rows, key=lambda r: (r[1] + rng.randrange(400) * 1_000_000, r[2]))
    parts = [arriving[i : i + 100] for i in range(0, 500, 100)]
    parts.append([("end", 10**12, 999), ("r1", 5, 1000)])
    schema = "request_id string, at long, event_id long"
    stream = stream_of(spark, parts, schema).withColumn("ts", F.timestamp_micros("at"))
    path, state_path = work_dir(spark, "out"), work_dir(spark, "state")
    requests.stream_dedup_requests(stream, path, state_path, work_dir(spark, "ckpt"), delay_seconds=400).awaitTermination()
    got = sorted(r["event_id"] for r in state.read_batches(spark, path).collect())
    assert got == sorted(greedy(rows, 300_000_000))
    assert [r["event_id"] for r in requests.late_requests(spark, state_path).collect()] == [1000]
    in_time_order = sorted(range(500), key=lambda i: (arriving[i][1], arriving[i][2]))
    assert in_time_order != list(range(500))


def arrivals(n: int):
    rows = [(e, 100, i) for e in range(6) for i in range(40) if (e, i) != (3, 7)]
    rows += RNG.sample(rows, 40)
    RNG.shuffle(rows)
    size = len(rows) // n + 1
    return rows, [rows[i : i + size] for i in range(0, len(rows), size)]


def test_ordered_commit_over_many_batches(spark, monkeypatch):
    """More batches than a snapshot covers, with a stop and a restart in the middle."""
    monkeypatch.setattr(state.DeltaTable.__init__, "__defaults__", (2,))
    rows, parts = arrivals(5)
    schema = "epoch_id long, leader_id int, entry_id long"
    source = work_dir(spark, "in")
    path, state_path, checkpoint = (work_dir(spark, n) for n in ("out", "state", "ckpt"))

    def run(files):
        stream = stream_of(spark, files, schema, source)
        query = ordered.stream_ordered_commit(stream, path, state_path, checkpoint)
        query.awaitTermination()
        return query.lastProgress.batchId + 1

    assert run(parts[:3]) == 3
    assert run(parts[3:]) == 5
    out = ordered.released(spark, path)
    released = [(r["epoch_id"], r["entry_id"]) for r in out.collect()]
    expected = {(e, i) for e, _, i in rows if (e, i) < (3, 7) or e > 3}
    assert len(released) == len(set(released)) and set(released) == expected
    # Within a unit a later batch never holds a smaller id.
    for unit in range(6):
        seen = [(r["batch"], r["entry_id"]) for r in out.filter(f"epoch_id = {unit}").collect()]
        assert [i for _, i in sorted(seen)] == list(range(len(seen)))
    frontier = ordered.committed(spark, state_path, 5)
    held = ordered.held(spark, path, state_path, spark.createDataFrame([], schema).schema, 5)
    waiting = ordered.stalled(held, frontier).collect()
    assert [(r["epoch_id"], r["next_id"], r["held_from"], r["held_to"]) for r in waiting] == [(3, 7, 8, 39)]
    everything = spark.createDataFrame(rows, schema)
    twin = {tuple(r) for r in lowest_missing(everything).collect()}
    assert {tuple(r) for r in frontier.collect()} == twin


def test_waiting_entries_are_written_once(spark):
    """A unit that is stalled from the first batch on: later batches write what they bring, until
    the missing id comes and all is released."""
    schema = "epoch_id long, leader_id int, entry_id long"
    stalled_ids = [(0, 100, i) for i in range(1, 700)]
    parts = [stalled_ids]
    parts += [[(0, 100, 700 + b), (1, 100, b), (1, 100, b), (0, 100, 5 + b)] for b in range(22)]
    parts.append([(0, 100, 0)])
    path, state_path = work_dir(spark, "out"), work_dir(spark, "state")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = ordered.stream_ordered_commit(stream_of(spark, parts, schema), path, state_path, work_dir(spark, "ckpt"))
    query.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    out = ordered.released(spark, path)
    counts = {r["batch"]: r["n"] for r in out.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {b + 1: 1 for b in range(22)} | {23: 722}
    assert out.select("epoch_id", "entry_id").distinct().count() == out.count()
    for batch in range(1, 23):
        assert spark.read.schema(schema).parquet(f"{path}/waiting/batch={batch}").count() == 1
        for name, most in (("frontier", 2), ("masks", 2)):
            assert spark.read.parquet(f"{state_path}/{name}/delta={batch}").count() <= most
    # Masks of blocks that are passed do not stay, those that wait do: 722 ids in 64s.
    snapshot = spark.read.parquet(f"{state_path}/masks/snapshot=20")
    assert snapshot.count() <= 722 // 64 + 2
    assert ordered.held(spark, path, state_path, out.drop("batch").schema, 24).isEmpty()
    assert ordered.held(spark, path, state_path, out.drop("batch").schema, 23).count() == 721


def test_a_repeated_batch_changes_nothing(spark):
    table = state.DeltaTable(
        work_dir(spark, "table"), ordered.FRONTIER_SCHEMA, state.max_per_key(UNIT, "next_id"), 2
    )
    for batch in range(5):
        for _ in range(2):
            table.before(spark, batch)
            delta = spark.createDataFrame([(batch % 2, 100, batch)], ordered.FRONTIER_SCHEMA)
            table.add(delta, batch)
    assert {tuple(r) for r in table.before(spark, 5).collect()} == {(0, 100, 4), (1, 100, 3)}


STATES = "ts timestamp, node_id long, partition_id long, depth int, leader_id long, is_leader boolean, num_entries long"


def states(spark):
    rows = [
        (f"2024-01-01 00:00:{second:02d}", node, node % 2, 1, None, node < 2, (second * 7 + node * 13) % 50)
        for second in range(40)
        for node in range(6)
    ]
    rows.append(("2024-01-02 00:00:00", 0, 0, 1, None, True, 0))
    df = spark.createDataFrame(rows, STATES.replace("timestamp", "string"))
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    parts = [df.filter(f"second(ts) div 10 = {i} AND ts < '2024-01-02'") for i in range(4)]
    return [*parts, df.filter("ts >= '2024-01-02'")], df.filter("ts < '2024-01-02'")


def closed(df):
    kept = df.filter("window_start < '2024-01-02'").drop("batch")
    columns = sorted(kept.columns)
    return sorted((tuple(r[c] for c in columns) for r in kept.collect()), key=repr)


def test_telemetry_streams_equal_their_batch_twins(spark):
    from shelfmark.operators import telemetry as batch

    parts, whole = states(spark)
    path = work_dir(spark, "out")
    stream = telemetry.stream_replication_lag(stream_of(spark, parts))
    state.run_append(stream, path, work_dir(spark, "ckpt")).awaitTermination()
    assert closed(spark.read.parquet(path)) == closed(batch.replication_lag(whole))

    path = work_dir(spark, "out")
    telemetry.stream_percentile_lag(stream_of(spark, parts), path, work_dir(spark, "ckpt")).awaitTermination()
    assert closed(state.read_batches(spark, path)) == closed(batch.percentile_lag(whole))

    path = work_dir(spark, "out")
    telemetry.stream_shard_overview(stream_of(spark, parts), path, work_dir(spark, "ckpt")).awaitTermination()
    windowed = batch.in_windows(whole)
    twin = batch.shard_overview(batch.latest_state(windowed, ["window_start", "node_id"]), ["window_start"])
    assert closed(state.read_batches(spark, path)) == closed(twin)


def test_percentiles_by_hand(spark):
    from shelfmark.operators.telemetry import percentile_lag

    values = [RNG.randrange(30) for _ in range(57)]
    df = spark.createDataFrame([(v,) for v in values], "num_entries long")
    got = percentile_lag(df.withColumn("ts", F.lit("2024-01-01 00:00:01").cast("timestamp"))).first()
    lags = sorted(max(values) - v for v in values)
    assert tuple(got)[1:] == tuple(lags[57 * q // 100] for q in (50, 75, 90))


def test_dumps_are_replayed_whole(spark):
    _, whole = states(spark)
    path = work_dir(spark, "dump")
    keep = F.col("node_id") != 3
    stream = stream_of(spark, [whole])
    dumps.write_windows(stream, path, work_dir(spark, "ckpt"), keep=keep, per_dump=2).awaitTermination()
    stored = spark.read.parquet(path)
    assert stored.select("dump").distinct().count() == 4
    out = work_dir(spark, "out")
    replayed = dumps.replay_windows(spark, path)
    state.run_append(replayed, out, work_dir(spark, "ckpt")).awaitTermination()
    again = spark.read.parquet(out)
    assert again.count() == whole.filter(keep).count()
    assert again.select("window_start", "node_id", "num_entries").exceptAll(
        stored.select("window_start", "node_id", "num_entries")
    ).isEmpty()


def test_unit_advance_follows_reports(spark):
    schema = "epoch_id long, leader_id int, num_entries long, status string, pull_status string, seq long"
    parts = [
        [(0, 100, 3, "ONGOING", "PENDING", 0)],
        [(0, 100, 5, "COMPLETED", "PENDING", 1), (2, 100, 5, "COMPLETED", "PENDING", 2)],
        [(1, 100, 4, "COMPLETED", "SKIP", 3)],
    ]
    frontier = spark.createDataFrame([(0, 100, 5)], ordered.FRONTIER_SCHEMA)
    path = work_dir(spark, "out")
    ordered.stream_unit_advance(
        stream_of(spark, parts, schema), frontier, path, work_dir(spark, "state"), work_dir(spark, "ckpt")
    ).awaitTermination()
    got = [tuple(r)[:2] for r in state.read_batches(spark, path).orderBy("batch").select(*UNIT, "batch").collect()]
    assert got == [(0, 100), (0, 100), (2, 100)]


def test_unit_pointer_equals_the_batch_twin(spark, monkeypatch):
    """Reports in no order over many batches, with sizes that grow behind the pointer, epochs that
    are missing for a while, and blocks of three epochs."""
    from shelfmark.operators.counts import latest_unit
    from shelfmark.operators.units import tracked_unit

    monkeypatch.setattr(ordered, "EPOCHS", 3)
    rng = random.Random(3)
    schema = "epoch_id long, leader_id int, num_entries long, status string, pull_status string, seq long"
    reports = []
    for epoch in [*range(16), -2]:
        for leader in range(100, 101 + epoch % 3):
            for _ in range(rng.randrange(1, 3)):
                status = rng.choice(["COMPLETED", "COMPLETED", "COMPLETED", "ONGOING"])
                reports.append([epoch, leader, rng.randrange(8), status, rng.choice(["PENDING", "SKIP"])])
    rng.shuffle(reports)
    seqs = rng.sample(range(1000), len(reports))
    rows = [(*r, q) for r, q in zip(reports, seqs, strict=True)]
    # Epoch 0 comes first, so that there is something to follow from the first batch on.
    rows.sort(key=lambda r: r[0] != 0)
    parts = [rows[i : i + 9] for i in range(0, len(rows), 9)]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    done = [(e, leader, rng.choice([5, 8, 8, 8])) for e in range(16) for leader in range(100, 103)]
    frontier = spark.createDataFrame(done, ordered.FRONTIER_SCHEMA)
    path, state_path = work_dir(spark, "out"), work_dir(spark, "state")
    ordered.stream_unit_advance(
        stream_of(spark, parts, schema), frontier, path, state_path, work_dir(spark, "ckpt")
    ).awaitTermination()
    written = state.read_batches(spark, path)
    for batch in range(len(parts)):
        whole = spark.createDataFrame([r for p in parts[: batch + 1] for r in p], schema)
        twin = [r.asDict() for r in tracked_unit(latest_unit(whole), frontier).collect()]
        got = [r.asDict() for r in written.filter(f"batch = {batch}").drop("batch").collect()]
        assert got == twin, batch
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_unit_pointer_at_flat_cost(spark, monkeypatch):
    """One unit in each of 12 batches: a batch writes the block that it reports, and of each block
    two versions stay."""
    monkeypatch.setattr(ordered, "EPOCHS", 4)
    schema = "epoch_id long, leader_id int, num_entries long, status string, pull_status string, seq long"
    parts = [[(b, 100, 2, "COMPLETED", "PENDING", b)] for b in range(12)]
    parts[-1].append((3, 100, 9, "COMPLETED", "PENDING", 99))
    frontier = spark.createDataFrame([(b, 100, 2) for b in range(12)], ordered.FRONTIER_SCHEMA)
    path, state_path = work_dir(spark, "out"), work_dir(spark, "state")
    read = []
    original = state.BlockTable.before

    def counted(self, session, blocks, batch_id):
        blocks = list(blocks)
        read.append((batch_id, len(blocks)))
        return original(self, session, blocks, batch_id)

    monkeypatch.setattr(state.BlockTable, "before", counted)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    ordered.stream_unit_advance(
        stream_of(spark, parts, schema), frontier, path, state_path, work_dir(spark, "ckpt")
    ).awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = {r["batch"]: r["epoch_id"] for r in state.read_batches(spark, path).collect()}
    assert got == {b: b for b in range(11)} | {11: 3}
    assert max(n for _, n in read[:-4]) <= 2
    table = state.BlockTable(state_path, ordered.UNIT_STATE_SCHEMA)
    assert all(len(table._versions(spark, b)) <= 2 for b in range(3))


def test_window_processor_on_a_stream(spark):
    """User code in three steps, its first in Python, equals the batch form; open windows alone are
    kept, and packets behind the watermark are ignored."""
    from pyspark.sql import types as T

    from shelfmark.operators import telemetry as batch

    schema = T.StructType([T.StructField("window_start", T.TimestampType()), *(T.StructField(c, T.LongType()) for c in ("top", "packets"))])

    def busiest(rows):
        found = rows.groupby("window_start", as_index=False)["num_entries"].agg(["max", "size"])
        return found.rename(columns={"max": "top", "size": "packets"})

    processor = batch.WindowProcessor(
        batch.python_partial(busiest, schema),
        lambda rows: rows.groupBy("window_start").agg(F.max("top").alias("top"), F.sum("packets").alias("packets")),
        lambda rows: rows.select("window_start", (F.col("top") * F.col("packets")).alias("load")),
        schema,
    )
    parts, whole = states(spark)
    late = parts[0].limit(5)
    path, state_path = work_dir(spark, "out"), work_dir(spark, "state")
    telemetry.stream_window_processor(
        stream_of(spark, [*parts, late]), processor, path, state_path, work_dir(spark, "ckpt")
    ).awaitTermination()
    out = state.read_batches(spark, path)
    assert closed(out) == closed(batch.process_windows(whole, processor))
    assert out.filter("window_start < '2024-01-02'").select("batch").distinct().count() > 2
    assert spark.read.parquet(f"{state_path}/partial/delta=5").isEmpty()
    assert spark.read.parquet(f"{state_path}/partial/delta=2").count() == 2


def test_routing_table_changes_by_bucket(spark):
    """A batch writes the buckets that it touches, and the table equals that of all samples."""
    from shelfmark.operators.peers import BUCKET, freshest_peers

    schema = "category_id long, depth int, partition_id long, node_id long, num_entries long, is_lg_member boolean, is_nated boolean, round long"
    parts = [[(b % 3, 1 + (n + b) % 2, b % 3, n, n * b, False, False, b) for n in range(9)] for b in range(6)]
    path = work_dir(spark, "table")
    stream = stream_of(spark, parts, schema)
    telemetry.stream_freshest_peers(stream, path, work_dir(spark, "ckpt"), 4).awaitTermination()
    for batch in range(6):
        touched = spark.read.parquet(f"{path}/delta={batch}").select(*BUCKET).distinct().collect()
        assert len(touched) <= len({(r[0], r[1], r[2]) for r in parts[batch]})
    whole = spark.createDataFrame([r for p in parts for r in p], schema)
    columns = [*BUCKET, "node_id", "round"]
    twin = freshest_peers(whole.withColumn("age", 10 - F.col("round")), 4).select(*columns)
    table = telemetry.routing_table(path, whole.schema).before(spark, 6)
    assert sorted(map(tuple, table.select(*columns).collect())) == sorted(map(tuple, twin.collect()))


def test_native_dedup_drops_repeats(spark):
    at = 1_700_000_000
    rows = [("a", at, 1), ("a", at + 10, 2), ("b", at, 3)]
    stream = stream_of(spark, [rows], "request_id string, at long, event_id long")
    stream = stream.withColumn("ts", F.timestamp_seconds("at"))
    path = work_dir(spark, "out")
    state.run_append(requests.native_dedup(stream, ["request_id"]), path, work_dir(spark, "ckpt")).awaitTermination()
    assert sorted(r["request_id"] for r in spark.read.parquet(path).collect()) == ["a", "b"]


