"""Fixtures of the tests of this folder: odd documents, and plain versions to compare with."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of their input.
CLASHING = ("key", "hash", "unit", "task", "node", "label", "bucket", "row_key", "low", "key_of_row", "text_key", "class_id")


def documents(spark, rows, clashing=True):
    """A table of documents from (doc_id, text) pairs, in several partitions."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA).repartition(3)
    if clashing:
        for name in CLASHING:
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def odd_rows():
    """Null and empty texts, a null id, blanks only, repeated rows, a very long text, no letters."""
    long_text = prose(99, 60_000, 5000)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\x0c\r "),
        (None, prose(5, 80)),
        (5, prose(5, 80)),
        (5, prose(5, 80)),
        (6, long_text),
        (7, "1234 5678 !!"),
        (8, "one"),
        (9, " naïve  café \U0001f600 中文"),
        (None, None),
    ]


def changed(text, share, seed):
    """The text with a share of its words replaced."""
    rng = random.Random(seed)
    words = text.split(" ")
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {n: root(n) for n in nodes}


def distance(a, b):
    """Edit distance by the full table."""
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]
