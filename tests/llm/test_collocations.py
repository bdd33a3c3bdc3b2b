"""Bidirectional FM-index and phrase collocations against counts by hand."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_support import odd_rows, prose

from shelfmark.llm.collocations import collocations
from shelfmark.llm.fm_index import BidirectionalIndex

SCHEMA = "doc_id long, text string, lang string, words string, keys string, n string, a string, w1 string"


def grams(pieces, length):
    return Counter(tuple(p[i : i + length]) for p in pieces for i in range(len(p) - length + 1))


@pytest.mark.parametrize("seed", range(30))
def test_index(seed):
    """Intervals of all phrases, grown at either end in any order, in both indexes."""
    rng = random.Random(seed)
    pieces = [[rng.randrange(1, 2 + seed % 5) for _ in range(rng.randrange(9))] for _ in range(rng.randrange(1, 9))]
    pieces = [p for p in pieces if p] or [[1]]
    text = np.array([0, *(x for p in pieces for x in [*p, 0])], np.int32)
    index = BidirectionalIndex(text, 5)
    phrases = index.words()
    for length in range(1, 6):
        places = index.places(phrases)
        names = [tuple(text[p : p + length]) for p in places.tolist()]
        assert Counter(dict(zip(names, phrases.size.tolist(), strict=True))) == grams(pieces, length)
        for name, low, other, size in zip(names, phrases.low, phrases.low_reversed, phrases.size, strict=True):
            for row in range(size):
                at = index.forward.suffix[low + row]
                assert tuple(text[at : at + length]) == name
                at = index.reversed.suffix[other + row]
                assert tuple(text[::-1][at : at + length][::-1]) == name
        if length < 5:
            before = names
            left = rng.random() < 0.5
            phrases = index.extend_left(phrases) if left else index.extend_right(phrases)
            for place, parent in zip(index.places(phrases).tolist(), phrases.parent.tolist(), strict=True):
                longer = tuple(text[place : place + length + 1])
                assert before[parent] == (longer[1:] if left else longer[:-1])
    with pytest.raises(ValueError):
        for _ in range(9):
            phrases = index.extend_left(phrases)


def plain(rows, least, most, top):
    pieces = {}
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            pieces.setdefault(lang or "und", []).append([w for w in re.split("[ \t]+", piece) if w])
    out = []
    for lang, some in pieces.items():
        n = sum(map(len, some))
        f = {}
        for length in range(1, most + 1):
            f |= {k: v for k, v in grams(some, length).items() if v >= least}
        around = {}
        for phrase, a in f.items():
            for i in range(len(phrase)):
                for j in range(i + 1, len(phrase) + 1):
                    if j - i < len(phrase):
                        around[phrase[i:j]] = max(around.get(phrase[i:j], 0), a)
        found = []
        for phrase, a in f.items():
            if len(phrase) > 1 and around.get(phrase, 0) < a:
                cuts = [(1000 * a * n // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "x", "x", "x", "x") for i, t, lang in rows], SCHEMA).repartition(4)


def some_rows():
    rng = random.Random(4)
    rows = []
    for i in range(120):
        words = prose(i, 150, 30).split(" ")
        for at in range(0, 140, 20):
            words[at : at + 6] = ["New", "york", "stock", "ÉX", "of", "THE"][: rng.randrange(2, 7)]
        marks = "".join(rng.choice([" ", " ", " ", "\t ", ". ", ", ", "\n", "; "]) + w for w in words)
        rows.append((i, marks, ["en", "fr", None, "und"][i % 4]))
    rows += [rows[0]] * 30  # repeated rows
    return rows + [(i, t, "en") for i, t in odd_rows()]


@pytest.mark.parametrize(("least", "top"), [(20, 2000), (5, 7), (3, 40)])
def test_against_plain_version(spark, least, top):
    rows = some_rows()
    got = collocations(table(spark, rows), min_count=least, top=top).collect()
    assert sorted(map(tuple, got)) == plain(rows, least, 5, top)


def test_small_shards(spark):
    """Counts are sums over shards: cut into many, and with texts larger than a shard."""
    rows = some_rows()
    got = collocations(table(spark, rows), min_count=20, shard_bytes=2000).collect()
    assert sorted(map(tuple, got)) == plain(rows, 20, 5, 2000)


def test_products_beyond_64_bits(spark):
    """The score's own expression on numbers whose product passes 64 bits."""
    df = spark.createDataFrame([(9 * 10**12, 9 * 10**13, 9 * 10**12 + 1, 9 * 10**12 + 7)], "a long, n long, l long, r long")
    got = df.selectExpr(
        "(cast(1000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0)))"
        " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) AS score"
    ).first()[0]
    assert got == 1000 * 9 * 10**12 * 9 * 10**13 // ((9 * 10**12 + 1) * (9 * 10**12 + 7))


def test_empty_tables(spark):
    assert collocations(table(spark, [])).collect() == []
    assert collocations(table(spark, [(1, None, None), (2, "a b", "en")])).collect() == []
