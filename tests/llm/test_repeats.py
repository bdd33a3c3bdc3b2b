from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from llm_support import DOC_SCHEMA, documents, odd_rows, prose

from shelfmark.llm.repeats import decoded, decoded_sorted, encoded, encoded_sorted, remove_repeats
from shelfmark.llm.words import SLICE_BYTES, word_slices


def plain(rows, window=13):
    """(doc_id, words, removed, kept text) of each row, by a table of all windows."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, words in split:
        if i is not None:
            for at in range(len(words) - window + 1):
                key = tuple(words[at : at + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for at in range(len(words) - window + 1):
            if i is not None and least[tuple(words[at : at + window])] < i:
                gone.update(range(at, at + window))
        kept = b" ".join(w for n, w in enumerate(words) if n not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


def check(spark, rows):
    got = remove_repeats(documents(spark, rows), texts=True).collect()
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got), key=repr) == plain(rows)


def test_random_overlaps(spark):
    """Texts made of shared passages at all offsets; few words, so that runs overlap in many ways."""
    rng = random.Random(5)
    passages = [[f"p{j}{rng.randrange(3)}" for j in range(rng.randrange(10, 40))] for _ in range(6)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 9))]
            part = rng.choice(passages)
            at = rng.randrange(0, 12)
            words += part[at:]
        rows.append((rng.randrange(60), " ".join(words)))
    check(spark, rows)


def test_few_words(spark):
    rng = random.Random(6)
    check(spark, [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60)))) for i in range(40)])


def test_odd_rows(spark):
    rows = odd_rows()
    check(spark, [*rows, (60, rows[6][1]), (-3, rows[6][1][1000:5000]), (61, prose(5, 80)), (-(2**63), "a " * 20), (2**63 - 1, "a " * 30)])


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
    assert remove_repeats(documents(spark, [(1, "only")])).count() == 1


def test_codes():
    values = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (decoded_sorted(encoded_sorted(values)) == values).all()
    assert (decoded(encoded(values.view(np.int64)), np.int64) == values.view(np.int64)).all()
    assert len(decoded(encoded(values[:0]), np.uint64)) == 0


def test_words_over_slices():
    """Equal words hash equally wherever they stand; blanks are those of the contract."""
    texts = [prose(1, 300), None, "", "a b c d\x0be\x0cf\x1fg", prose(1, 300), "x" * (SLICE_BYTES + 10), "x"]
    found = {}
    count = 0
    for words in word_slices(pa.array(texts)):
        for a, b, h in zip(words.start, words.end, words.hashes, strict=True):
            assert found.setdefault(words.data[a:b].tobytes(), int(h)) == int(h)
            count += 1
    assert count == sum(len((t or "").encode().split()) for t in texts)
    assert len(set(found.values())) == len(found)
