"""Large uneven groups against brute force: one group holds most of the rows."""

from __future__ import annotations

import bisect
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import batch_search, counts, ordering, peers, shards, units
from shelfmark.streaming import requests

RNG = random.Random(7)


def uneven(n: int, groups: int = 6) -> list[int]:
    """Group numbers, two thirds of them 0."""
    return [0 if RNG.random() < 0.66 else RNG.randrange(groups) for _ in range(n)]


def test_positions(spark):
    rows = [(g, RNG.randrange(50), i) for i, g in enumerate(uneven(5000))]
    df = spark.createDataFrame(rows, "g int, k int, i int").repartition(7)
    got = ordering.positions(df, ["g"], [F.desc("k"), F.asc("i")]).collect()
    wanted = {}
    by_group = defaultdict(list)
    for g, k, i in rows:
        by_group[g].append((-k, i))
    for g, keys in by_group.items():
        for position, (_, i) in enumerate(sorted(keys)):
            wanted[i] = position
    assert {r["i"]: r["position"] for r in got} == wanted


def random_ids(n: int) -> list[tuple]:
    """Distinct ids over few and over many epochs, some far apart."""
    found = set()
    while len(found) < n:
        epoch = RNG.choice([3, RNG.randrange(20), RNG.randrange(50_000)])
        found.add((epoch, RNG.randrange(3), RNG.randrange(9000)))
    return sorted(found, key=lambda _: RNG.random())


def test_select_rank(spark):
    ids = random_ids(3000)
    rows = [(g, *i) for g, i in zip(uneven(len(ids)), ids)]
    df = spark.createDataFrame(rows, "g int, epoch_id long, leader_id int, entry_id long")
    by_group = defaultdict(list)
    for g, *i in rows:
        by_group[g].append(tuple(i))
    got = counts.median_id(df, ["g"]).collect()
    assert {r["g"]: (r["epoch_id"], r["leader_id"], r["entry_id"]) for r in got} == {
        g: sorted(v)[len(v) // 2] for g, v in by_group.items()
    }
    whole = counts.median_id(df).first()
    assert (whole["epoch_id"], whole["leader_id"], whole["entry_id"]) == sorted(ids)[len(ids) // 2]


def test_median_of_equal_ids(spark):
    df = spark.createDataFrame([(5, 1, 2)] * 9 + [(5, 1, 3)] * 4, "epoch_id long, leader_id int, entry_id long")
    assert counts.median_id(df).first()["entry_id"] == 2


def test_following(spark):
    keys = sorted(RNG.sample(range(-2000, 2000), 600))
    rows = [(g, k, k if RNG.random() < 0.1 else None) for g, k in zip(uneven(len(keys), 3), keys)]
    df = spark.createDataFrame(rows, "g int, k long, v long")
    got = ordering.following(df, ["g"], "k", F.col("v"), "n").collect()
    for r in got:
        later = [v for g, k, v in rows if g == r["g"] and k > r["k"] and v is not None]
        assert r["n"] == (later[0] if later else None)


def test_gaps_and_prefix(spark):
    rows = [(0, i) for i in range(4000) if i % 501 != 500] + [(1, i) for i in (2, 3, 7)] + [(2, 0)]
    df = spark.createDataFrame(rows, "epoch_id long, entry_id long").withColumn("leader_id", F.lit(1))
    gaps = {(r["epoch_id"], r["gap_from"], r["gap_to"]) for r in units.gap_report(df).collect()}
    assert gaps == {(0, i, i) for i in range(500, 3999, 501)} | {(1, 0, 1), (1, 4, 6)}
    prefix = {r["epoch_id"]: (r["lowest_missing"], r["stranded"]) for r in units.contiguous_prefix(df).collect()}
    assert prefix[0][0] == 500 and prefix[0][1] == sum(1 for e, i in rows if e == 0 and i > 500)
    assert prefix[1] == (0, 3) and prefix[2] == (1, 0)
    assert units.stranded_ids(df).filter("epoch_id = 1").count() == 3


def test_ring(spark):
    nodes = RNG.sample(range(200_000), 40)
    keys = [RNG.choice([777, RNG.randrange(250_000)]) for _ in range(2000)] + nodes[:3]
    got = peers.ring_assign(
        spark.createDataFrame([(k,) for k in keys], "key long"),
        spark.createDataFrame([(n,) for n in nodes], "node long"),
        "key", "node",
    ).collect()
    ring = sorted(nodes)
    assert len(got) == len(keys)
    for r in got:
        at = bisect.bisect_left(ring, r["key"])
        assert r["owner"] == (ring[at] if at < len(ring) else ring[0])


def test_range_cover(spark):
    bounds = [(0, 0), (5, 5), (0, 15), (3, 300), (16, 4095), (-70, 33), (10, 9), (None, 12), (1000, None),
              (None, None), (2**59, 2**62), (123_456_789, 987_654_321_000)]
    ranges = spark.createDataFrame(
        [(i, "s", lo, hi) for i, (lo, hi) in enumerate(bounds)], "i int, kind string, lo long, hi long"
    )
    keys = defaultdict(list)
    for r in batch_search.range_cover(ranges).collect():
        keys[r["i"]].append(r["key"])
    probes = {-71, -70, -1, 0, 1, 4, 5, 6, 9, 12, 13, 15, 16, 33, 34, 300, 301, 999, 1000, 4095, 4096,
              2**59 - 1, 2**59, 2**60, 123_456_788, 123_456_789, 987_654_321_000, 987_654_321_001}
    for i, (lo, hi) in enumerate(bounds):
        assert len(keys[i]) == len(set(keys[i])) and len(keys[i]) <= 480
        for x in probes:
            hits = sum(f"s{level}:{x >> (4 * level)}" in keys[i] for level in range(16))
            inside = (lo is None or x >= lo) and (hi is None or x <= hi)
            assert hits == int(inside), (lo, hi, x)


def greedy(rows, ttl, seen=None):
    last = dict(seen or {})
    kept = set()
    for at, event, key in sorted((at, e, k) for k, at, e in rows):
        if key not in last or at - last[key] > ttl:
            last[key] = at
            kept.add(event)
    return kept, last


def test_accept_requests(spark):
    rows = []
    for event in range(3000):
        key = "hot" if RNG.random() < 0.5 else f"r{RNG.randrange(40)}"
        rows.append((key, RNG.randrange(0, 2000) * 1_000_000, event))
    df = spark.createDataFrame(rows, "request_id string, at long, event_id long")
    df = df.withColumn("ts", F.timestamp_micros("at"))
    kept, last = greedy(rows, 300_000_000)
    got = requests.accept_requests(df).collect()
    assert {r["event_id"] for r in got} == kept and len(got) == len(kept)
    later = [(k, at + 2_000_000_000, e + 10_000) for k, at, e in rows[:800]]
    df = spark.createDataFrame(later, "request_id string, at long, event_id long")
    seen = spark.createDataFrame(list(last.items()), "request_id string, seen long")
    got = requests.accept_requests(df.withColumn("ts", F.timestamp_micros("at")), seen).collect()
    assert {r["event_id"] for r in got} == greedy(later, 300_000_000, last)[0]


def split_until_fits(rows, threshold, max_depth):
    """Brute force over whole rows: (category, partition, depth) -> list of ids."""
    todo = defaultdict(list)
    for category, *i in rows:
        todo[(category, 0, 0)].append(tuple(i))
    done, stuck = {}, set()
    while todo:
        key, ids = todo.popitem()
        category, partition, depth = key
        if len(ids) < threshold or depth >= max_depth:
            done[key] = ids
            continue
        median = sorted(ids)[len(ids) // 2][:2]
        low = [i for i in ids if i[:2] < median]
        if not low:
            done[key] = ids
            stuck.add(key)
            continue
        todo[(category, partition + (1 << depth), depth + 1)] = low
        todo[(category, partition, depth + 1)] = [i for i in ids if i[:2] >= median]
    return done, stuck


def test_shard_until_fits(spark):
    rows = []
    for category, sizes in {"a": [40] * 30, "b": [5, 90, 3, 4], "c": [200], "d": [1, 300, 10, 10, 10]}.items():
        rows += [(category, e // 2, e % 2, i) for e, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "category string, epoch_id long, leader_id int, entry_id long")
    df = df.withColumn("partition_id", F.lit(0).cast("long")).withColumn("depth", F.lit(0))
    placement, stuck = shards.shard_until_fits(df, 60, 15)
    done, alone = split_until_fits(rows, 60, 15)
    got = {
        (r["category"], r["partition_id"], r["depth"], r["epoch_id"], r["leader_id"]): r["num_entries"]
        for r in placement.collect()
    }
    wanted = Counter((*key, e, leader) for key, ids in done.items() for e, leader, _ in ids)
    assert got == dict(wanted)
    assert {(r["category"], r["partition_id"], r["depth"]) for r in stuck.collect()} == alone
    assert alone


def test_no_group_in_one_task(spark):
    """Random 64-bit keys in a single group: no exchange gathers the rows."""
    keys = sorted({RNG.randrange(-(2**62), 2**62) for _ in range(4000)})
    df = spark.createDataFrame([(k,) for k in keys], "key long").withColumn("g", F.lit(0))
    value = F.when(F.col("key") % 3 == 0, F.col("key"))
    found = ordering.following(df, ["g"], "key", value, "next")
    got = {r["key"]: r["next"] for r in found.collect()}
    wanted, ahead = {}, None
    for k in reversed(keys):
        wanted[k] = ahead
        ahead = k if k % 3 == 0 else ahead
    assert got == wanted
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


def test_one_hot_shard_in_one_split(spark):
    ids = sorted({(RNG.randrange(200), RNG.randrange(2), i) for i in range(4000)})
    rows = [("hot" if i % 3 else f"c{i % 5}", *x) for i, x in enumerate(ids)]
    df = spark.createDataFrame(rows, "category string, epoch_id long, leader_id int, entry_id long")
    df = df.withColumn("partition_id", F.lit(1).cast("long")).withColumn("depth", F.lit(1))
    out = shards.shard_split(df, 1000).collect()
    hot = sorted(x for c, *x in rows if c == "hot")
    median = tuple(hot[len(hot) // 2][:2])
    assert len(out) == len(rows)
    for r in out:
        low = r["category"] == "hot" and (r["epoch_id"], r["leader_id"]) < median
        assert r["partition_id"] == (3 if low else 1)
        assert r["depth"] == (2 if r["category"] == "hot" else 1)
