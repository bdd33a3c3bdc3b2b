from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import DOC_SCHEMA, changed, components_of, distance, documents, odd_rows, prose

from shelfmark.llm.alignment import banded_distance, near
from shelfmark.llm.components import components
from shelfmark.llm.near_copies import (
    COUNT_SLOTS,
    _pairs_by_word,
    _rarest,
    _slots,
    keep_one_of_each,
    near_copies,
    rare_words,
)
from shelfmark.llm.order_sketch import order_sketches
from shelfmark.llm.words import word_slices

WORDS = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12)


@settings(max_examples=400, deadline=None)
@given(WORDS, WORDS, st.integers(0, 12))
def test_banded_distance(a, b, limit):
    assert banded_distance(a, b, limit) == min(distance(a, b), limit + 1)


def plain_classes(rows, similarity=0.8):
    words = {}
    for i, t in rows:
        if i is not None:
            words.setdefault(i, set()).add(tuple((t or "").lower().encode().split()))
    ids = sorted(words)
    links = [
        (a, b)
        for x, a in enumerate(ids)
        for b in ids[x + 1 :]
        if any(v and w and near(v, w, similarity) for v in words[a] for w in words[b])
    ]
    return components_of(ids, links)


def test_against_all_pairs(spark, small_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    found = {r.doc_id: r.class_id for r in near_copies(documents(spark, rows)).collect()}
    assert found == plain_classes(rows)


def test_planted_groups(spark):
    """A large group around one text, a chain in which only neighbours are near, and others."""
    base = prose(1, 200, 10**6)
    rows = [(100 + i, changed(base, 0.02, i)) for i in range(60)]
    rows += [(200 + i, base.upper()) for i in range(30)]
    step = prose(2, 100, 10**6).split(" ")
    for i in range(6):
        rows.append((300 + i, " ".join([f"n{j}" for j in range(14 * i)] + step[14 * i :])))
    rows += [(400 + i, prose(50 + i, 120, 10**6)) for i in range(40)]
    random.Random(3).shuffle(rows)
    found = {r.doc_id: r.class_id for r in near_copies(documents(spark, rows)).collect()}
    assert found == plain_classes(rows)
    assert len({found[i] for i in range(300, 306)}) == 1 and not near(
        rows_of(rows, 300), rows_of(rows, 305), 0.8
    )


def test_hot_passages_with_unlike_least_texts(spark):
    """Pairs of near copies, all of whose common k-mers stand in a passage that unlike texts with
    lesser ids have too: small buckets, and one passage that makes large ones."""
    rows = []
    for g in range(200):
        passage = prose(10_000 + (g if g >= 40 else 0), 96, 10**6)
        rows += [(20 * g + i, f"{passage} {prose(20_000 + 20 * g + i, 40, 10**6)}") for i in range(12)]
        # The other words stay near copies of one another by their length alone.
        own = prose(70_000 + g, 6, 10**6)
        rows += [(10_000 + 2 * g + i, f"{passage} {own} {prose(40_000 + 2 * g + i, 14, 10**6)}") for i in range(2)]
    found = {r.doc_id: r.class_id for r in near_copies(documents(spark, rows, clashing=False)).collect()}
    assert all(found[i] == i for i, _ in rows if i < 10_000)
    assert all(found[10_001 + 2 * g] == found[10_000 + 2 * g] for g in range(200))


@pytest.mark.parametrize("words", [60, 150, 500])
def test_recall_by_share_of_changed_words(spark, words):
    """Pairs with words replaced at random places, up to the threshold itself."""
    shares = [0.03, 0.08, 0.12, 0.15, 0.18]
    rows, pairs = [], {s: [] for s in shares}
    for n, share in enumerate(shares):
        for i in range(100):
            a, b = 10_000 * n + 2 * i, 10_000 * n + 2 * i + 1
            text = prose(a, words, 10**6)
            other = changed(text, share, b)
            rows += [(a, text), (b, other)]
            if near(text.encode().split(), other.encode().split(), 0.8):
                pairs[share].append((a, b))
    found = {r.doc_id: r.class_id for r in near_copies(documents(spark, rows, clashing=False)).collect()}
    for share, some in pairs.items():
        assert len(some) >= 50
        assert sum(found[a] == found[b] for a, b in some) >= 0.9 * len(some), share


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=14), min_size=2, max_size=8))
def test_linked_texts_share_a_rare_word(texts):
    lines = [" ".join(f"w{x}" for x in t) for t in texts]
    counts = np.zeros(COUNT_SLOTS, np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lines))), pa.array(lines)], names=["doc_id", "text"])
    for part in _slots(iter([batch])):
        counts[part.column(0).to_numpy()] += part.column(1).to_numpy()
    rare = next(_rarest(SimpleNamespace(value=counts), 0.8)(iter([batch]))).column(1).to_pylist()
    for i, a in enumerate(lines):
        for j, b in enumerate(lines):
            if near(a.encode().split(), b.encode().split(), 0.8):
                assert set(rare[i]) & set(rare[j])


def test_texts_meet_once_and_only_if_enough_words_follow(spark):
    """Texts of few words in all lengths: each linkable pair of unlike labels meets at one word, and
    most of the other pairs that share rare words never do."""
    texts = [(i, prose(i, 20 + i % 60, 300)) for i in range(300)]
    texts += [(1000 + i, changed(texts[i][1], 0.1, i)) for i in range(300)]
    # One label for a group that shares most of its words: these lead to no other label.
    texts += [(5000 + i, changed(prose(999, 120, 10**6), 0.02, i)) for i in range(100)]
    labels = [5000 if i >= 5000 else i for i, _ in texts]
    rows = [(i, t, label) for (i, t), label in zip(texts, labels, strict=True)]
    words = rare_words(spark.createDataFrame(rows, "doc_id long, text string, label long").repartition(3))
    kept = words.collect()
    assert not any(r.node >= 5000 for r in kept)
    pairs = [(r.a, r.b) for r in _pairs_by_word(words, 0.8).collect()]
    assert len(pairs) == len(set(pairs))
    split = {i: t.encode().split() for i, t in texts}
    linked = {(i, 1000 + i) for i in range(300) if near(split[i], split[1000 + i], 0.8)}
    assert len(linked) > 200 and linked <= set(pairs)
    by_key = {}
    for r in kept:
        by_key.setdefault(r.key, set()).add(r.node)
    sharing = {(a, b) for some in by_key.values() for a in some for b in some if a < b}
    assert len(pairs) < len(sharing) / 3


def rows_of(rows, doc_id):
    return dict(rows)[doc_id].lower().encode().split()


def test_odd_rows(spark):
    rows = odd_rows()
    got = near_copies(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    named = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert named == plain_classes(rows)
    assert sorted((r.class_id for r in got if r.doc_id is None), key=str) == [5, None]


def test_empty(spark):
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert near_copies(empty).collect() == []
    assert keep_one_of_each(empty).collect() == []


def test_one_of_each_stays(spark):
    rows = [*odd_rows(), (50, prose(5, 80) + " end"), (4, prose(5, 80))]
    docs = documents(spark, rows)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 8, 9]


def test_order_counts():
    """The same k-mers in another order give other sketches; equal texts give equal ones."""
    a, b = prose(7, 60, 10**6).split(" "), prose(8, 60, 10**6).split(" ")
    texts = [" ".join(a + b), " ".join(b + a), " ".join(a + b), ""]
    keys = order_sketches(next(word_slices(pa.array(texts))), 5, 3, 64)
    assert (keys[0] == keys[2]).all() and not keys[3].any()
    assert 0.1 < (keys[0] == keys[1]).mean() < 0.6


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)]
    nodes = {n for pair in links for n in pair if pair[0] != pair[1]}
    want = components_of(nodes, [p for p in links if p[0] != p[1]])
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == want
