"""Chat formatting, packing, license scans and the pipeline."""

from __future__ import annotations

import math
import random
import re
import textwrap
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import CLASHING, DOC_SCHEMA, documents, odd_rows, prose
from pyspark.sql import functions as F
from test_near_copies import plain_classes
from test_search_operators import plain_pairs
from test_text_operators import plain_disclosing
from tokenizers import Tokenizer

import corpus_pipeline
from shelfmark.llm.chat import END, format_conversations, prefix_targets, read_turns, unescaped
from shelfmark.llm.licenses import TEMPLATES, license_blocks, scan_licenses
from shelfmark.llm.packing import Encoder, first_fit_decreasing, pack
from shelfmark.llm.packing_queries import op9_pack_first_fit
from shelfmark.llm.personal_data import base_spans, sanitised
from shelfmark.llm.vocabulary import tokenizer_path
from shelfmark.llm.work import durable

# Chat formatting

TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    rng = random.Random(1)
    marks = ["### ", "#", "</turn>", "</", "\\", "\\b", "\\h", "<\\s", ": ", "\n", "assistant", "é", "\U0001f600", " ", "x", "/turn>\n"]
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "a: b\\#", "</turn>\n", ""])
            rows.append((c, t, role, "".join(rng.choice(marks) for _ in range(rng.randrange(0, 12)))))
    rows += [(50, 1, None, None), (50, 0, "assistant", None), (50, 1, "assistant", "twice"), (50, 1, "assistant", "twice")]
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (51, 0, "assistant", "long " * 100_000)]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    for name in (*CLASHING, "body", "segment", "until", "number", "trained"):
        df = df.selectExpr("*", f"'z' AS {name}")
    by_conv = defaultdict(list)
    for c, t, role, text in rows:
        by_conv[c].append((t is not None, t or 0, role or "", text or ""))
    formatted = format_conversations(df)
    told = formatted.select("*", read_turns(F.col("formatted")).alias("turns")).collect()
    assert len(told) == len(by_conv)
    for r in told:
        want = [x[2:] for x in sorted(by_conv[r.conv_id])]
        assert [tuple(t) for t in r.turns] == want
        assert r.formatted.count(END) == len(want)
    examples = prefix_targets(formatted).select("*", unescaped(F.col("target")).alias("plain")).collect()
    whole = {r.conv_id: r.formatted for r in told}
    for e in examples:
        assert whole[e.conv_id].startswith(e.context + e.target + END)
        assert e.context.count(END) + 1 == e.context.count("### ")
    replies = defaultdict(list)
    for e in sorted(examples, key=lambda e: e.example):
        replies[e.conv_id].append(e.plain)
    assert dict(replies) == {
        c: texts for c, turns in by_conv.items() if (texts := [x[3] for x in sorted(turns) if x[2] == "assistant"])
    }
    assert format_conversations(spark.createDataFrame([], TURNS)).collect() == []


# Packing


def checked_pieces(rows, texts, sequence=2048):
    """That pieces cover their documents once and fill their sequences without gaps; the share of padding."""
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in texts:
        want[i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    pieces = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and 0 < r.length <= sequence
        pieces[r.doc_id, r.start, r.doc_tokens].append(bytes(r.ids))
    # documents by id; rows that share an id may share starts, so their pieces are matched as a multiset
    told = Counter((i, s, d, p) for (i, s, d), ps in pieces.items() for p in ps)
    cut = Counter()
    for (i, ids), n in want.items():
        for s in range(0, len(ids) // 4, sequence):
            cut[i, s, len(ids) // 4, ids[4 * s : 4 * (s + sequence)]] += n
    assert told == cut
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= sequence
    return 1 - sum(r.length for r in rows) / (sequence * len(bins))


def test_packing_of_the_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = pack(docs, tokenizer_path()).collect()
    assert checked_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()]) < 0.02
    digest = {(r.doc_id, r.start, r.length): r.ids_crc32 for r in op9_pack_first_fit(spark, small_dir).collect()}
    assert digest == {(r.doc_id, r.start, r.length): crc32(bytes(r.ids)) for r in rows}


def test_packing_of_odd_rows(spark):
    texts = [*odd_rows(), (70, "a <|endoftext|>  b<|endoftext|>"), (71, "  two\n\n  blanks \t's 'LL"), (72, "ﬁİß​　中文")]
    rows = pack(documents(spark, texts), tokenizer_path(), group_documents=4).collect()
    checked_pieces(rows, texts)
    assert pack(spark.createDataFrame([], DOC_SCHEMA), tokenizer_path()).collect() == []


def test_groups_do_not_depend_on_the_order_of_rows(spark):
    """The same rows of a task in another order, with equal rows and null ids among them, give the
    same pieces in the same places; equal rows spread over the groups."""
    rows = [(i, prose(i, 50)) for i in range(30)] + [(7, prose(7, 50))] * 20 + [(None, "a b c")] * 3 + [(8, None)]
    mixed = random.Random(2).sample(rows, len(rows))
    packed = [
        sorted(map(tuple, pack(documents(spark, given).coalesce(1), tokenizer_path(), group_documents=6).collect()), key=repr)
        for given in (rows, mixed)
    ]
    assert packed[0] == packed[1]
    assert len({r[5] >> 32 for r in packed[0] if r[0] == 7}) > 3


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encoder(text):
    if not hasattr(test_encoder, "pair"):
        test_encoder.pair = (Encoder(tokenizer_path(), 1), Tokenizer.from_file(tokenizer_path()))
    own, plain = test_encoder.pair
    assert np.frombuffer(own.encode(text), "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(sizes):
    """Bins and offsets against a walk over all bins."""
    bins, offsets = first_fit_decreasing(np.array(sizes, np.int64), 50)
    room = [50] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next(b for b, r in enumerate(room) if r >= sizes[i])
        assert (bins[i], offsets[i]) == (at, 50 - room[at])
        room[at] -= sizes[i]


# License scans


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def test_blocks_against_all_pairs(spark):
    """Random blocks and templates over few words, for several thresholds."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(14)]
    templates = [(f"t{i}", " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for i in range(12)] + [("none", " !")]
    rows = [(i, "\n".join(" ".join(rng.choices(vocabulary + ["other"], k=rng.randrange(0, 14))) for _ in range(4))) for i in range(60)]
    rows += [*odd_rows(), (0, rows[0][1])]
    for share in (0.5, 0.8, 1.0):
        want = set()
        for i, text in rows:
            for n, line in enumerate((text or "").split("\n")):
                block = set(plain_words(line))
                for k, (label, t) in enumerate(templates):
                    tokens = set(plain_words(t))
                    if tokens and len(block & tokens) >= math.ceil(share * len(tokens) - 1e-9):
                        want.add((i, n, label, k, round(len(block & tokens) / len(tokens), 9)))
        got = license_blocks(documents(spark, rows), templates, share).collect()
        assert {(r.doc_id, r.block_no, r.label, r.template_no, round(r.containment, 9)) for r in got} == want
        assert len(want) > 20


def test_phrases(spark):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc", "b b": "bb"}
    texts = [
        "Under the\nMIT-License. under THE mit license2 under the mit licence",
        "CC BY-NC 4.0 ccé by nc cc by nccc by nc",
        "Apache License, Version 2.0; apache license version 20",
        "b b b b",
        "under the mit license",
        "LicenKe under the mit ſicense cc by ncK",
        None,
        "",
        "!!! cc by nc !!!",
    ]
    rows = [*enumerate(texts, 100), *odd_rows()]
    got = scan_licenses(documents(spark, rows), phrases, [("t", "apache license version 2")], 1.0).collect()
    assert len(got) == len(rows)
    found = sorted(((r.doc_id, r.n_words, sorted((p.label, p.word) for p in r.places)) for r in got), key=repr)
    want = []
    for i, text in rows:
        words = plain_words(text)
        places = [
            (label, at)
            for phrase, label in phrases.items()
            for at in range(len(words))
            if words[at : at + len(phrase.split())] == phrase.split()
        ]
        want.append((i, len(words), sorted(places)))
    assert found == sorted(want, key=repr)
    assert {r.doc_id for r in got if r.template_labels} == {102}
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert scan_licenses(empty).collect() == []


def test_wrapped_templates(spark):
    """Every template, wrapped at several widths and behind comment marks, between other lines."""
    rows = []
    for label, text in TEMPLATES:
        for width in (8, 25, 72):
            for mark in ("", " * ", "# \n# "):
                lines = [mark + line for line in textwrap.wrap(text, width, break_long_words=False)]
                rows.append((len(rows), label, "\n".join(["/* Copyright", "", *lines, "", "import os"])))
    found = scan_licenses(documents(spark, [(i, t) for i, _, t in rows])).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert all(label in got[i].template_labels and got[i].containment == 1 for i, label, _ in rows)
    apart = [(1, "\n".join(" filler" * 60 + " " + w for w in TEMPLATES[0][1].split()))]
    assert [r.template_labels for r in scan_licenses(documents(spark, apart)).collect()] == [[]]


# Pipeline


def test_pipeline(spark, small_dir):
    """Each stage against a plain version, on what the stage before it kept."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    odd = [(-1, None), (-2, "12 34 !!"), (-3, ""), (-4, "Mail me at some.one@mail.example.org and call me"), (-5, items[0][1] + " and more words")]
    docs = durable(docs.unionByName(documents(spark, odd, clashing=False)))
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = durable(stage(spark, docs, small_dir))
        if number < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            after = sorted((r.doc_id, r.text) for r in docs.collect())
        if name == "language":
            assert after == sorted(x for x in before if any(c.isalpha() for c in x[1] or ""))
        elif name == "near_duplicates":
            classes = plain_classes(before)
            assert after == sorted(x for x in before if classes[x[0]] == x[0])
        elif name == "decontamination":
            leaks = {d for d, _ in plain_pairs(before, items)}
            assert -5 in leaks and after == sorted(x for x in before if x[0] not in leaks)
        elif name == "personal_data":
            told = plain_disclosing(before)
            want = [(i, sanitised(t, [s[:3] for s in base_spans(t)] + more)) for (i, t), more in zip(before, told, strict=True)]
            assert after == sorted(want) and dict(after)[-4] == "Mail me at [EMAIL] and call me"
        else:
            checked_pieces(docs.collect(), before)


def test_pipeline_runs(spark, small_dir):
    assert corpus_pipeline.run(spark, small_dir).count() > 100


def test_prose_is_repeatable():
    assert prose(1, 5) == prose(1, 5)
