"""Exact top-k search, and containment search of test items."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from llm_support import DOC_SCHEMA, documents, odd_rows, prose

from shelfmark.llm.contamination import bin_minima, contaminated
from shelfmark.llm.topk import top_k

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_top(rows, is_query, k):
    used = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    best = {}
    for q, a in used:
        if is_query(q):
            for c, b in used:
                if c != q and len(a) == len(b):
                    score = sum(x * y for x, y in zip(a, b, strict=True))
                    score = max(-(2**63), min(2**63 - 1, score))
                    key = (q, c)
                    best[key] = max(best.get(key, score), score)
    out = []
    for q in sorted({q for q, _ in best}):
        ranked = sorted((-s, c) for (p, c), s in best.items() if p == q)[:k]
        out += [(q, n, c, -s) for n, (s, c) in enumerate(ranked, 1)]
    return out


def vectors(n, size=8, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=size)]) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 7])
def test_top_k(spark, block):
    rows = vectors(300)
    rows += [(900 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(5, rows[17][1]), (5, rows[18][1]), (20, rows[3][1])]  # repeated ids
    rows += [(600, None), (None, rows[1][1]), (601, [1.0, None] * 4), (602, [math.nan] * 8), (603, [math.inf] * 8)]
    rows += [(620, [0.5, 0.25]), (621, [0.125, 2.0]), (640, []), (641, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).repartition(5).selectExpr("*", "1 AS task", "2 AS score")
    rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = top_k(df, df.filter("vec_id % 20 = 0"), query_block=block).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, lambda q: q % 20 == 0, 10)


def test_large_products(spark):
    rows = [(i, [float(np.float32(v * 1e12)) for v in x]) for i, x in vectors(12, 3)] + [(50, [1e30, 1.0, -1.0]), (51, [1e30, -1e30, 2.0])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    assert sorted(map(tuple, top_k(df, df, k=4).collect())) == plain_top(rows, lambda q: True, 4)


def test_no_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert top_k(empty, empty).collect() == []


def plain_pairs(rows, items, share=0.8):
    def shingles(text):
        w = (text or "").lower().encode().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    out = {}
    for d, text in rows:
        s = shingles(text)
        for i, item in items:
            t = shingles(item)
            if d is not None and i is not None and t and len(s & t) >= share * len(t):
                out[d, i] = max(out.get((d, i), (0, 0)), (len(s & t), len(t)))
    return out


def test_containment(spark):
    """Items of many sizes, whole, cut at either end, and scattered, in short and long documents."""
    rng = random.Random(4)
    items = [(i, prose(1000 + i, rng.choice([5, 6, 9, 20, 60, 300]), 10**6)) for i in range(40)]
    items += [(100, None), (101, "four words of text"), (102, ""), (None, prose(1, 30)), (103, "Mixed CASE item of six words")]
    rows = odd_rows()
    for d in range(20, 120):
        words = prose(d, rng.choice([0, 30, 400, 6000]), 10**6).split(" ")
        for _ in range(rng.randrange(0, 3)):
            part = rng.choice(items[:40])[1].split(" ")
            cut = rng.choice([0, 0, 1, len(part) // 8, len(part) // 3])
            at = rng.randrange(len(words) + 1)
            words[at:at] = part[cut:]
        rows.append((d, " ".join(words)))
    rows += [(200, "x MIXED case ITEM of\nsix words y"), (20, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "'y' AS item_text")
    got = contaminated(documents(spark, rows), bench).collect()
    want = plain_pairs(rows, items)
    assert {(r.doc_id, r.item_id): (r.shared, r.item_shingles) for r in got} == want and len(want) > 30
    assert len(got) == len(want)


def test_containment_of_nothing(spark):
    docs, items = documents(spark, odd_rows()), spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs, items).collect() == []
    some = spark.createDataFrame([(1, prose(5, 60))], "item_id long, text string")
    assert contaminated(spark.createDataFrame([], DOC_SCHEMA), some).collect() == []
    assert [(r.doc_id, r.containment) for r in contaminated(docs, some).collect()] == [(5, 1.0)]


def test_bin_minima():
    """Least hashes by bin, as a loop finds them, in partitions of different sizes."""
    rng = np.random.default_rng(3)
    docs = np.sort(rng.integers(0, 12, 3000) ** 2 // 10)
    hashes = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
    for finer in (0, 2):
        want = set()
        for d in set(docs.tolist()):
            own = sorted(set(hashes[docs == d].tolist()))
            bits = max(1, math.ceil(math.log2(len(own))) + finer)
            bins = {}
            for h in own:
                bins.setdefault(h >> (64 - bits), h)
            want |= {(d, h) for h in bins.values()}
        got = bin_minima(docs, hashes, finer)
        assert set(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want
