"""License scans with DataFrame functions only: phrases, and an exact set-similarity join of
text blocks with license templates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in lower-cased text: ASCII other than letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8
#: Stands for the end of a line among words; no separator.
BREAK = "␤"

# The phrases and labels of the base scan.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening sentences of public licenses and of their notices.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
)


def lowered(text: Column) -> Column:
    """Lower-case, null as empty. The one other character whose lower case is an ASCII letter
    (the Kelvin sign) is put out of the way first, so that only A-Z become a-z."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))


def words_of(lower_text: Column) -> Column:
    """Words as an array; its first and last entries may be empty."""
    return F.split(lower_text, SEPARATORS)


def word_count(parts: Column) -> Column:
    first = (F.element_at(parts, 1) == "").cast("long")
    last = F.when(F.size(parts) > 1, (F.element_at(parts, -1) == "").cast("long")).otherwise(0)
    return F.size(parts).cast("long") - first - last


def phrase_places(lower_text: Column, parts: Column, phrase: str) -> Column:
    """Word numbers (from 0) at which the phrase's words stand one after the other."""
    words = phrase.split()
    edge = SEPARATORS.removesuffix("+")
    seen = lower_text.contains(max(words, key=len)) & lower_text.rlike(
        f"(?:^|{edge})" + SEPARATORS.join(words) + f"(?:$|{edge})"
    )
    shift = (F.element_at(parts, 1) == "").cast("int")

    def begins(i: Column) -> Column:
        same = F.lit(True)
        for j, word in enumerate(words):
            same = same & (F.get(parts, i + j) == word)
        return same

    last = F.size(parts) - len(words)
    places = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), begins)
    return F.when(seen & (last >= 0), F.transform(places, lambda i: (i - shift).cast("long"))).otherwise(
        F.array().cast("array<bigint>")
    )


def scan_phrases(docs: DataFrame, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """Add to each row of (doc_id, text) its number of words, and for each phrase found its label
    and places: ``doc_id``, ``row_key``, ``n_words``, ``places`` (array of label and word number).

    ``row_key`` stands for the row's id and text, so rows that share an id stay apart unless
    their texts are equal too.
    """
    rows = docs.select(
        F.col("doc_id").alias("doc_id"),
        F.xxhash64(F.col("doc_id"), F.col("text")).alias("row_key"),
        lowered(F.col("text")).alias("low"),
    ).withColumn("parts", words_of(F.col("low")))

    def labelled(phrase: str, label: str) -> Column:
        places = phrase_places(F.col("low"), F.col("parts"), phrase)
        return F.transform(places, lambda i: F.struct(F.lit(label).alias("label"), i.alias("word")))

    found = F.flatten(F.array(*[labelled(phrase, label) for phrase, label in phrases.items()]))
    return rows.select("doc_id", "row_key", word_count(F.col("parts")).alias("n_words"), found.alias("places"))


def token_order(docs: DataFrame, tokens: Sequence[str]) -> list[str]:
    """The given tokens from rare to frequent over all words of all texts; ties by name.

    One row per token of the templates reaches the driver, whatever the size of the corpus.
    """
    words = docs.select(F.explode(words_of(lowered(F.col("text")))).alias("token"))
    counted = words.filter(F.col("token").isin(list(tokens))).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in counted.collect()}
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def license_blocks(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    containment: float = CONTAINMENT,
    separator: str = "\n",
    wrapped: bool = False,
) -> DataFrame:
    """Every (text block, template) of which the block holds at least the share ``containment``
    of the template's distinct words: ``doc_id``, ``row_key``, ``block_no``, ``label``,
    ``template_no``, ``containment``.

    Blocks are what stands between ``separator`` in a text. With ``wrapped`` there is one more
    around every separator, with a null ``block_no``: the words before and after it, on each side
    as many as the longest template has, divided by ``containment``. So a sentence is found over
    however many lines it runs, also with foreign words (comment marks) in it. All words are ordered by their
    frequency in the corpus, rare ones first; words of no template cannot add to an overlap and
    are left out of the sets. A block can reach the overlap needed only if its first words by
    that order meet the template's first words (prefix filter), if it has enough words (length
    filter), and if enough words follow the first one in common on both sides (positional
    filter). What remains is counted exactly. Blocks without any template's first words are
    dropped before their words are sorted. Null texts have no blocks; an empty table gives no
    rows; templates without words match nothing.
    """
    spark = docs.sparkSession
    sets = [sorted(set(_plain_words(text))) for _, text in templates]
    order = token_order(docs, sorted({t for s in sets for t in s}))
    rank = {token: i for i, token in enumerate(order)}
    table, heads, first_words = [], [], set()
    for number, ((label, _), tokens) in enumerate(zip(templates, sets, strict=True)):
        if not tokens:
            continue
        ranks = sorted(rank[t] for t in tokens)
        need = max(1, math.ceil(containment * len(ranks) - 1e-9))
        table.append((number, label, ranks, need, len(ranks)))
        for at, r in enumerate(ranks[: len(ranks) - need + 1]):
            heads.append((r, number, at, need, len(ranks)))
            first_words.add(order[r])
    template_table = _local(
        spark, table, {"template_no": pa.int32(), "label": pa.string(), "ranks": pa.list_(pa.int32()), "need": pa.int32(), "size": pa.int32()}
    )
    prefixes = _local(spark, heads, dict.fromkeys(("token", "template_no", "at", "need", "size"), pa.int32()))

    ranked = F.create_map(*[F.lit(x) for token, r in rank.items() for x in (token, r)]) if rank else F.create_map()
    lines = docs.select(
        F.col("doc_id").alias("doc_id"),
        F.xxhash64(F.col("doc_id"), F.col("text")).alias("row_key"),
        lowered(F.col("text")).alias("low"),
    )
    any_first = "|".join(sorted(first_words)) or r"(?!)"
    texts = lines.filter(F.col("low").rlike(any_first))
    lines = texts.select("doc_id", "row_key", F.posexplode(F.split("low", separator)).alias("block_no", "line"))
    lines = lines.filter(F.col("line").rlike(any_first))
    blocks = lines.select(
        "doc_id",
        "row_key",
        "block_no",
        F.array_sort(
            F.array_distinct(
                F.filter(F.transform(words_of(F.col("line")), lambda w: ranked[w]), lambda r: r.isNotNull())
            )
        ).alias("block"),
    )
    if wrapped and table:
        longest = max(len(_plain_words(text)) for _, text in templates)
        around = _around_breaks(texts, separator, ranked, math.ceil(longest / containment), min(row[3] for row in table))
        blocks = blocks.unionByName(around)
    room = F.least(F.col("size") - F.col("at"), F.size("block") - F.col("place"))
    pairs = (
        blocks.select("*", F.posexplode("block").alias("place", "token"))
        .join(prefixes, "token")
        .filter((F.size("block") >= F.col("need")) & (F.col("place") <= F.size("block") - F.col("need")))
        .filter(room >= F.col("need"))
        .select("doc_id", "row_key", "block_no", "block", "template_no")
        .distinct()
    )
    overlap = F.size(F.array_intersect("block", "ranks"))
    return (
        pairs.join(template_table, "template_no")
        .withColumn("overlap", overlap)
        .filter(F.col("overlap") >= F.col("need"))
        .select(
            "doc_id",
            "row_key",
            "block_no",
            "label",
            "template_no",
            (F.col("overlap") / F.col("size")).alias("containment"),
        )
    )


def _around_breaks(texts: DataFrame, separator: str, ranked: Column, reach: int, least: int) -> DataFrame:
    """The sorted ranks of ``reach`` words before and as many after each separator, where they
    are at least ``least``; equal ones of a text once."""
    def bound(value: Column, use) -> Column:
        """``use(value)``, with the value computed once and not for each element of a loop."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def block(ranks: Column, place: Column) -> Column:
        first = F.greatest(place - reach, F.lit(0))
        near = F.slice(ranks, first + 1, place + reach - first)
        return F.array_sort(F.array_distinct(F.filter(near, lambda r: r >= 0)))

    def blocks(every: Column) -> Column:
        marks = F.filter(F.transform(every, lambda w, i: F.when(w == BREAK, i)), lambda i: i.isNotNull())
        places = F.array_distinct(F.transform(marks, lambda i, number: i - number))
        ranks = F.transform(F.filter(every, lambda w: w != BREAK), lambda w: F.coalesce(ranked[w], F.lit(-1)))
        found = bound(ranks, lambda r: F.transform(places, lambda place: block(r, place)))
        return F.array_distinct(F.filter(found, lambda b: F.size(b) >= least))

    every = F.filter(words_of(F.regexp_replace("low", separator, f" {BREAK} ")), lambda w: w != "")
    return (
        texts.filter(F.col("low").rlike(separator))
        .select("doc_id", "row_key", F.explode(bound(every, blocks)).alias("block"))
        .select("doc_id", "row_key", F.lit(None).cast("int").alias("block_no"), "block")
    )


def _local(spark: SparkSession, rows: list[tuple], types: dict[str, pa.DataType]) -> DataFrame:
    """A small literal table, whose size the planner knows."""
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return spark.createDataFrame(
        pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(types.items(), columns, strict=True)})
    )


def _plain_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def scan_licenses(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """Both scans, one row per document: ``doc_id``, ``n_words``, ``places``, ``template_labels``
    (distinct) and ``containment``, the best of its blocks (0 if none is found). Blocks are lines,
    and the words around every line's end.

    Null texts are empty; rows that share id and text give equal rows; a null doc_id stays null.
    """
    found = (
        license_blocks(docs, templates, containment, wrapped=True)
        .groupBy(F.col("doc_id").alias("of_doc"), F.col("row_key").alias("of_row"))
        .agg(F.collect_set("label").alias("template_labels"), F.max("containment").alias("containment"))
    )
    rows = scan_phrases(docs, phrases)
    same = (F.col("row_key") == F.col("of_row")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))
    return rows.join(found, same, "left").select(
        "doc_id",
        "n_words",
        "places",
        F.coalesce("template_labels", F.array().cast("array<string>")).alias("template_labels"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"),
    )
