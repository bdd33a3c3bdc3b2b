"""Language identification, personal data, and the quality classifier."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from llm_support import DOC_SCHEMA, documents, odd_rows, prose
from pyspark.sql import functions as F

from shelfmark.llm.language import (
    BUCKET_BITS,
    SMOOTHING,
    _buckets,
    _pieces,
    fold_of,
    identify,
    keep_identified,
    score_texts,
    train,
)
from shelfmark.llm.language_queries import op2_naive_bayes_language
from shelfmark.llm.personal_data import (
    GENERALISE,
    KINDS,
    NEAR,
    REMOVE,
    base_spans,
    find_personal_data,
    near_terms,
    sanitise,
    sanitised,
    terms,
)
from shelfmark.llm.quality import BAD, GOOD, LABELLERS, NONE, estimate, quality, vote_matrix

# Language identification


def test_held_out_accuracy(spark, small_dir):
    found = op2_naive_bayes_language(spark, small_dir)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "lang", fold_of(F.col("doc_id")).alias("fold"))
    rows = found.join(docs, "doc_id").collect()
    assert all(r.held_out == (r.fold == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 40 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_counts_by_hand(spark):
    """Weights and scores against a loop over n-grams in dictionaries."""
    labelled = [("aa", "Abra kadabra, abra!"), ("aa", "bar"), ("bb", "xyzzy xyz 12 zyx"), ("bb", None), (None, "abra xyz")]
    df = spark.createDataFrame(labelled, "lang string, text string").repartition(3)
    model = train(df.selectExpr("*", "1 AS bucket", "2 AS n"))

    def grams(text):
        clean = " " + re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower())).strip() + " "
        if not clean.strip():
            return []
        return [clean[i : i + n] for n in (1, 2, 3) for i in range(len(clean) - n + 1) if clean[i : i + n] != " "]

    def bucket(gram):
        # the last bucket of a text that ends with the gram, found through the operator's own hash
        codes = np.array([ord(c) for c in gram], np.uint64)
        return list(_buckets(codes, np.zeros(len(gram), int)))[len(gram) - 1][0][0]

    counts = {"aa": {}, "bb": {}}
    for lang, text in labelled:
        if lang:
            for g in grams(text):
                b = bucket(g)
                counts[lang][b] = counts[lang].get(b, 0) + 1
    assert model.languages == ["aa", "bb"]
    assert np.allclose(model.priors, math.log(0.5))
    for text in ("abra", "zyx bar", "x", "Kadabra xyzzy"):
        total = []
        for lang in ("aa", "bb"):
            mass = sum(counts[lang].values()) + SMOOTHING * 2**BUCKET_BITS
            total.append(math.log(0.5) + sum(math.log((counts[lang].get(bucket(g), 0) + SMOOTHING) / mass) for g in grams(text)))
        names, score = score_texts(model, [text])
        best = max(total)
        assert names[0] == ("aa", "bb")[total.index(best)]
        assert score[0] == pytest.approx(1 / sum(math.exp(t - best) for t in total))


def test_language_of_odd_rows(spark):
    labelled = spark.createDataFrame([("en", prose(1, 50)), ("fr", "çà et là")], "lang string, text string")
    model = train(labelled)
    docs = documents(spark, odd_rows())
    found = identify(docs, model).collect()
    assert len(found) == len(odd_rows())
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert {i for i, r in by_id.items() if r.lang_pred == "und" and r.score == 0} == {1, 2, 3, 7}
    assert by_id[6].lang_pred == "en"
    kept = keep_identified(docs, model, 0.0)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 5, 5, 6, 8, 9]
    assert identify(spark.createDataFrame([], DOC_SCHEMA), model).collect() == []
    nothing = train(labelled.filter("lang IS NULL"))
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {"und"}
    with pytest.raises(ValueError, match="languages"):
        train(labelled, max_languages=1)


def test_long_texts_are_read_whole():
    whole = sum(len(codes) for codes, _ in _pieces(["ab " * 400_000]))
    assert whole >= 1_200_000


# Personal data

TEXTS = st.text(st.sampled_from("a.@-+ 01259().%,é\n"), max_size=60)


def plain_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(n - 9 * (n > 9) for n in doubled) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(TEXTS)
@example("a@b.c@d.e x@y 1.2.3.4.5 300.1.1.1 4111 1111-1111 1111 +1 (555) 123-4567..")
@example("@a.b@c.d ..@x.y 4111111111111111+14155550100 0004.0.0.0255")
def test_base_spans(text):
    assert [s[:3] for s in base_spans(text)] == plain_base(text)


def test_base_spans_of_the_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in find_personal_data(docs).collect():
        assert [tuple(s) for s in r.base] == plain_base(texts[r.doc_id])
        assert [tuple(s) for s in r.spans if s.kind in KINDS[:4]] == [tuple(s) for s in r.base]


def plain_disclosing(rows, min_texts=3):
    """(kind by term) of each row's text, by dictionaries over all rows."""
    texts = [t or "" for _, t in rows]
    found = [({f"{k}:{v}" for k, _, _, v in base_spans(t)}, {w for w, _, _ in terms(t)}) for t in texts]
    every = [{m.group().lower() for m in re.finditer(r"[^\W\d_]{3,}", t)} for t in texts]
    out = []
    for i, (entities, words) in enumerate(found):
        told = {}
        for e in entities:
            n_e = sum(e in x for x, _ in found)
            for w in words:
                with_both = [j for j, (x, y) in enumerate(found) if e in x and w in y]
                if len({texts[j] for j in with_both}) < min_texts or n_e == len(rows):
                    continue
                n_w = sum(w in x for x in every)
                share = math.log(len(with_both) * len(rows) / (n_w * n_e)) / math.log(len(rows) / n_e)
                if share >= GENERALISE:
                    told[w] = max(told.get(w, ""), "removed" if share >= REMOVE else "generalised")
        out.append(sorted((told[w], a, b) for w, a, b in terms(texts[i]) if w in told))
    return out


def test_disclosing_terms(spark):
    common = "the report was sent to the office and then to the archive"
    rows = [(i, f"{common} by Zanzibar agent {i} via x@y.org for gardening copy{'abcdef'[i % 6]}") for i in range(6)]
    rows += [(20 + i, f"{common} about gardening and nothing else {'ghijklm'[i]}") for i in range(3)]
    rows += [(40 + i, prose(i, 40).replace("w", "word")) for i in range(60)]
    rows += [(200, f"call +1 (555) 123-4567 {common}"), (201, "zanzibar alone"), (0, rows[0][1])]
    rows += odd_rows()
    got = find_personal_data(documents(spark, rows)).collect()
    want = sorted(((i, spans) for (i, _), spans in zip(rows, plain_disclosing(rows), strict=True)), key=repr)
    assert sorted(((r.doc_id, sorted(tuple(s) for s in r.spans if s.kind in KINDS[4:])) for r in got), key=repr) == want
    kinds = {k for _, spans in want for k, _, _ in spans}
    assert kinds == {"generalised", "removed"}
    assert not next(spans for i, spans in want if i == 201)


def weighed(rows):
    """Kind by document and term, from the formula of the docstring, by dictionaries over all rows."""
    texts = [t or "" for _, t in rows]
    held, stand = {}, {}
    for j, t in enumerate(texts):
        for k, _, _, value in base_spans(t):
            held.setdefault((k, value), set()).add(j)
        for w, _, _ in terms(t):
            stand.setdefault(w, set()).add(j)
    n, out = len(rows), {}
    for docs in held.values():
        for w, at in stand.items():
            both = docs & at
            if both and len(docs) < n:
                chance = 1 + (len(docs) / n) ** (len({texts[j] for j in both}) - 1)
                share = math.log(len(both) * n / (len(at) * len(docs) * chance)) / math.log(n / len(docs))
                if share >= GENERALISE:
                    for j in both:
                        kind = "removed" if share >= REMOVE else "generalised"
                        out[rows[j][0], w] = max(out.get((rows[j][0], w), ""), kind)
    return out


def test_values_of_one_or_two_texts(spark):
    """Values seldom stand in many documents; what stands only beside them gives them away."""
    rows = [(i, "the report about gardening is sent by the office") for i in range(1500)]
    rows += [(2000, "ask Quetzal about gardening: quiet@home.net"), (2001, "ask the office: 10.1.2.3")]
    rows += [(2100 + i, f"report by Xochitl about the office {w} +1 (555) 123-4567") for i, w in enumerate(("one", "two"))]
    got = {}
    for r in find_personal_data(documents(spark, rows)).collect():
        for kind, a, b in r.spans:
            if kind in KINDS[4:]:
                got[r.doc_id, dict(rows)[r.doc_id][a:b].lower()] = kind
    assert got == weighed(rows)
    assert got[2000, "quetzal"] == "generalised"
    assert got[2100, "xochitl"] == got[2101, "xochitl"] == "removed"
    assert not {w for _, w in got} & {"the", "office", "report", "gardening", "ask"}


def test_planted_names_and_rare_words_far_from_values(spark):
    """Names near an address in two texts or more are caught; words of one document that stand away
    from its address stay, and so do those near it that are found elsewhere as well."""
    rng = random.Random(4)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "qrstuvxyz"]
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
    letters = "abcdefghij"
    names = [f"Name{letters[i // 10]}{letters[i % 10]}" for i in range(30)]
    rows = [(i, plain(60)) for i in range(1500)]
    for i, name in enumerate(names):
        for copy in range(2 + i % 3):
            rare = " ".join(f"rare{letters[i // 10]}{letters[i % 10]}{letters[copy]}{c}" for c in "klmnop")
            text = f"{rare} {plain(30)} {name} {plain(3)} agent{letters[i % 10]}@mail{i}.net {plain(30)}"
            rows.append((10_000 + 10 * i + copy, text))
    rows += [(20_000 + i, f"{plain(10)} {names[0]} {plain(10)}") for i in range(3)]
    text_of, masked = dict(rows), {}
    for r in find_personal_data(documents(spark, rows)).collect():
        masked[r.doc_id] = {text_of[r.doc_id][a:b] for kind, a, b in r.spans if kind in KINDS[4:]}
    planted = [i for i in text_of if 10_010 <= i < 20_000]
    caught = sum(names[(i - 10_000) // 10] in masked[i] for i in planted)
    assert caught >= 0.9 * len(planted)
    assert not any("rare" in w for found in masked.values() for w in found)
    assert not any(names[0] in found for found in masked.values())
    assert sum(len(found) for found in masked.values()) <= 1.1 * len(planted)


def test_pairs_grow_with_values_not_with_texts():
    """A list of many addresses among many words: a bounded number of pairs for each address."""
    text = " ".join(f"word{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]} a{i}@b.org" for i in range(3000))
    assert len(near_terms(text)) <= 3000 * 2 * NEAR
    assert near_terms("one two six ten all a@b.org") == {
        ("email:a@b.org", w): w in ("six", "ten", "all") for w in ("one", "two", "six", "ten", "all")
    }


def test_names_inside_addresses_are_not_counted(spark):
    """A name that is part of its address too is counted where it stands plainly, as all counts are."""
    rows = [(i, f"the report {i} is sent by the office") for i in range(1000)]
    rows += [(2000 + i, f"the report {i} by zanzibar@y.org") for i in range(17)]
    rows += [(2100 + i, f"the report {i} by Zanzibar zanzibar@y.org") for i in range(3)]
    got = {}
    for r in find_personal_data(documents(spark, rows)).collect():
        for kind, a, b in r.spans:
            if kind in KINDS[4:]:
                got[r.doc_id, dict(rows)[r.doc_id][a:b].lower()] = kind
    assert got == weighed(rows) == {(2100 + i, "zanzibar"): "removed" for i in range(3)}


def test_sanitised_rows(spark):
    rows = [(i, f"Zanzibar{'xyz'[i]} Zanzibar met x@y.org here") for i in range(3)]
    rows += [(10 + i, prose(i, 30)) for i in range(50)] + [*odd_rows(), (99, "+14155550100")]
    docs = documents(spark, rows)
    out = sanitise(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    want = []
    for (i, t), told in zip(rows, plain_disclosing(rows), strict=True):
        spans = [s[:3] for s in base_spans(t or "")] + told
        want.append((i, t if t is None else sanitised(t, spans)))
    assert got == sorted(want, key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    assert "zanzibar " not in next(t for i, t in got if i == 0).lower()
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert sanitise(empty).collect() == [] and find_personal_data(empty).collect() == []


def test_overlapping_spans():
    assert sanitised("ab cd ef", [("card", 3, 5), ("phone", 0, 4)]) == "[PHONE] ef"


# Quality


def test_em_finds_accuracies():
    rng = np.random.default_rng(2)
    n, k = 40_000, len(LABELLERS)
    truth = rng.random(n) < 0.7
    right = np.linspace(0.6, 0.95, k)
    matrix = np.full((n, k), NONE)
    for i in range(k):
        vote = np.where(rng.random(n) < right[i], truth, ~truth)
        matrix[:, i] = np.where(rng.random(n) < 0.8, np.where(vote, GOOD, BAD), NONE)
    codes, counts = np.unique(matrix @ (3 ** np.arange(k - 1, -1, -1)), return_counts=True)
    assert (vote_matrix(codes)[0] < 3).all()
    model = estimate(codes, counts)
    assert model.good == pytest.approx(0.7, abs=0.02)
    assert np.allclose(model.chances[:, GOOD, GOOD], right, atol=0.02)
    assert np.allclose(model.chances[:, BAD, BAD], right, atol=0.02)


def test_quality_against_labels(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = quality(docs).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows)
    good = [r for r in rows if r.quality == 1]
    assert sum(r.keep for r in good) >= 0.98 * len(good)


def test_quality_of_odd_rows(spark):
    found = quality(documents(spark, odd_rows()), steps=3).collect()
    assert len(found) == len(odd_rows())
    assert all(r.score == 0 and not r.keep for r in found if r.doc_id in (1, 2, 3))
    five = [tuple(r) for r in found if r.doc_id == 5]
    assert len(five) == 2 and five[0] == five[1]
    assert quality(spark.createDataFrame([], DOC_SCHEMA), steps=2).collect() == []
