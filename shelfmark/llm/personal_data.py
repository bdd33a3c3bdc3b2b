"""Personal data: patterns, and information-theoretic sanitisation of what else gives it away.

An entity is a value that the patterns find (an address, a number). A term meets it where it is
one of the ``NEAR`` terms before or behind the value. How much a term discloses of an entity that
it meets is the pointwise mutual information of the two over all documents, as a share of the
entity's own information: 1 where the term stands only near the entity, 0 where it is as frequent
as anywhere. The share is lowered by the odds that the two met by chance: even for a pair seen in
one text, and smaller by the entity's frequency for every further text. Terms at or above one
threshold are generalised, at or above a higher one removed, in the documents that hold the entity.

A share alone is no evidence: a term of one document meets whatever is there. So a lower bound of
the chance that the term stands near the entity (Wilson's, one standard error, over different
texts) must reach ``TRUST``, which takes two texts, however many documents there are; a single
meeting reaches ``TRUST_BESIDE``, which is enough for the ``BESIDE`` terms next to the value.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.work import durable, free_name, held, key_filter, rows_in_filter, small_batches

# Kinds of the base spans, in order, then those of the method.
KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
GENERALISE = 0.9
REMOVE = 0.99
NEAR = 8
BESIDE = 3
TRUST = 0.6
TRUST_BESIDE = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W\d_]{3,}")

SPAN = "array<struct<kind:string,start:long,end:long>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
MET_TYPE = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("beside", pa.bool_())]))
MET_SCHEMA = "text_key string, met array<struct<entity:string,term:string,beside:boolean>>"
BASE_SCHEMA = f"doc_id long, text_key string, base {SPAN}, entities array<string>"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The domain is matched at each @; the name before it is the run that ends there, so the
    first @ with both is the leftmost match."""
    done = 0
    for found in _DOMAIN.finditer(text):
        start = found.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < found.start():
            done = found.end()
            yield start, done


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Kind, start, end and plain value of what the patterns find, by start, then kind.

    Matches of a kind are leftmost and do not overlap; one that fails its test is dropped and
    the search goes on behind it.
    """
    spans = [("email", a, b, text[a:b].lower()) for a, b in _emails(text)] if "@" in text else []
    for found in _IP.finditer(text):
        parts = [p.lstrip("0") for p in found.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            spans.append(("ip", *found.span(), found.group()))
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 14:
            digits = _NOT_DIGIT.sub("", found.group())
            if 14 <= len(digits) <= 19 and _luhn(digits):
                spans.append(("card", *found.span(), digits))
    if "+" in text:
        for found in _PHONE.finditer(text):
            digits = _NOT_DIGIT.sub("", found.group())
            if 10 <= len(digits) <= 15:
                spans.append(("phone", *found.span(), digits))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, entities = [], []
        for text in batch.column(2):
            found = base_spans(text.as_py())
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b, _ in found])
            entities.append(sorted({f"{k}:{value}" for k, _, _, value in found}))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, SPAN_TYPE), pa.array(entities, pa.list_(pa.string()))],
            names=["doc_id", "text_key", "base", "entities"],
        )


def terms(text: str) -> Iterator[tuple[str, int, int]]:
    """Lower-cased runs of three or more letters that no base span touches, with their places."""
    taken: list[list[int]] = []
    for _, a, b, _ in base_spans(text):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    at = 0
    for found in _TERM.finditer(text):
        start, end = found.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at == len(taken) or end <= taken[at][0]:
            yield found.group().lower(), start, end


def term_set(text: str) -> set[str]:
    if base_spans(text):
        return {t for t, _, _ in terms(text)}
    return {t.lower() for t in _TERM.findall(text)}


def near_terms(text: str) -> dict[tuple[str, str], bool]:
    """Pairs of an entity and a term that meet in the text, and whether they stand side by side."""
    found = list(terms(text))
    starts = [start for _, start, _ in found]
    pairs: dict[tuple[str, str], bool] = {}
    for kind, start, _, value in base_spans(text):
        at = bisect_left(starts, start)
        for i in range(max(0, at - NEAR), min(len(found), at + NEAR)):
            pair = f"{kind}:{value}", found[i][0]
            pairs[pair] = pairs.get(pair, False) or at - BESIDE <= i < at + BESIDE
    return pairs


def _text_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [
                [{"entity": e, "term": t, "beside": beside} for (e, t), beside in sorted(near_terms(x.as_py()).items())]
                for x in part.column(1)
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, MET_TYPE)], names=["text_key", "met"])


def _count_known(known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents per term, of the terms that may be in the filter; base spans hold no terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(0):
                found = list(term_set(text.as_py()))
                if found:
                    keys = np.fromiter((crc32(t.encode()) for t in found), np.uint64, len(found))
                    keys |= keys << np.uint64(32)
                    counts.update(found[i] for i in np.flatnonzero(held(known.value, keys)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"]
            )

    return count


def _term_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            spans = []
            for text, told in zip(part.column(1), part.column(2), strict=True):
                level = {x["term"]: x["kind"] for x in told.as_py()}
                spans.append([{"kind": level[t], "start": a, "end": b} for t, a, b in terms(text.as_py()) if t in level])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, SPAN_TYPE)], names=["text_key", "found"])


def _whole(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("text_key"), text.alias("text"))


def _least_share(hits: Column, misses: Column) -> Column:
    """Wilson's lower bound, at one standard error, of the share of hits."""
    n = hits + misses
    p = hits / n
    return (p + 1 / (2 * n) - F.sqrt(p * (1 - p) / n + 1 / (4 * n * n))) / (1 + 1 / n)


@dataclass
class Disclosures:
    """Base spans of every row, and spans of disclosing terms by text."""

    base: DataFrame
    found: DataFrame


def disclosures(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> Disclosures:
    """Base spans by row, and the spans of terms that disclose an entity, by text.

    Every term is weighed against every entity that it meets; all counts are over the whole
    corpus. Of N documents e hold the entity, t the term, and in b of them, of d different texts,
    the two meet; the share is ``log(b * N / (t * e * (1 + (e / N) ** (d - 1)))) / log(N / e)``. As
    b is at most e, a pair with ``t > e * (N / e) ** (1 - generalise)`` cannot reach the threshold,
    and is dropped before the joint counts. The bound on evidence is of d meetings against t - b
    documents without one. An entity of all documents has nothing to disclose. A value brings at
    most 2 * ``NEAR`` pairs, so pairs grow with the values found, not with the length of texts.
    """
    small_batches(docs.sparkSession)
    rows = _whole(docs)
    base = durable(rows.mapInArrow(_base, BASE_SCHEMA))
    total = base.count()
    by_text = durable(
        base.filter(F.size("entities") > 0)
        .select("text_key", F.explode("entities").alias("entity"))
        .groupBy("text_key", "entity")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    entities = by_text.groupBy("entity").agg(F.sum("copies").alias("n_entity")).filter(F.col("n_entity") < total)
    held_in = durable(by_text.join(entities, "entity").select("text_key", "entity", "copies", "n_entity"))
    wanted = key_filter(held_in.select(F.xxhash64("text_key").alias("hash")), "hash")
    likely = rows_in_filter(rows.select("text_key", "text"), "text_key", wanted)
    texts = durable(likely.groupBy("text_key").agg(F.first("text").alias("text")))
    met = durable(texts.mapInArrow(_text_terms, MET_SCHEMA)).select("text_key", F.inline("met"))
    crc = F.crc32(F.col("term").cast("binary"))
    term_key = crc.bitwiseOR(F.shiftleft(crc, 32))
    known = key_filter(met.select(term_key.alias("hash")), "hash")
    n_term = rows.select("text").mapInArrow(_count_known(known), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    corpus, n_entity = F.lit(float(total)), F.col("n_entity")
    most = n_entity * F.pow(corpus / n_entity, F.lit(1 - generalise))
    pairs = durable(
        met.join(n_term, "term").join(held_in, ["text_key", "entity"]).filter(F.col("n_term") <= most * (1 + 1e-9))
    )
    joint = pairs.groupBy("term", "entity").agg(
        F.sum("copies").alias("n_both"),
        F.count(F.lit(1)).alias("texts"),
        F.bool_or("beside").alias("beside"),
        F.first("n_term").alias("n_term"),
        F.first("n_entity").alias("n_entity"),
    )
    chance = 1 + F.pow(n_entity / corpus, F.col("texts") - 1)
    told = F.log(F.col("n_both") * corpus / (F.col("n_term") * n_entity * chance))
    trust = _least_share(F.col("texts").cast("double"), (F.col("n_term") - F.col("n_both")).cast("double"))
    sure = (trust >= TRUST) | (F.col("beside") & (trust >= TRUST_BESIDE))
    telling = durable(
        joint.withColumn("share", told / F.log(corpus / n_entity))
        .filter((F.col("share") >= generalise) & sure)
        .select("term", "entity", F.when(F.col("share") >= remove, KINDS[5]).otherwise(KINDS[4]).alias("kind"))
    )
    per_text = (
        pairs.join(telling, ["term", "entity"])
        .groupBy("text_key", "term")
        .agg(F.max("kind").alias("kind"))
        .groupBy("text_key")
        .agg(F.collect_list(F.struct("term", "kind")).alias("told"))
    )
    found = texts.join(per_text, "text_key").select("text_key", "text", "told")
    return Disclosures(base, durable(found.mapInArrow(_term_spans, f"text_key string, found {SPAN}")))


def find_personal_data(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``doc_id``, ``base`` (spans of the patterns) and ``spans`` (these and the disclosing terms),
    each an array of (kind, start, end) in code points by start, then kind.

    Null texts are empty; rows are judged by their text, so repeated rows give equal rows and a
    null doc_id stays null. Documents without a base span have none of the method's either. An
    empty table gives no rows; other columns are ignored.
    """
    told = disclosures(docs, generalise, remove)
    none = F.array().cast(SPAN)
    both = told.base.join(told.found, "text_key", "left")
    return both.select("doc_id", "base", in_order(F.concat("base", F.coalesce("found", none))).alias("spans"))


def in_order(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(kinds, s["kind"]).alias("k"), s["end"].alias("b"), s["kind"].alias("kind"))
    )
    return F.transform(
        F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["a"].alias("start"), s["b"].alias("end"))
    )


def told_spans(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


# What stands for a span of each kind in sanitised text.
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalised": "[TERM]", "removed": ""}


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced; overlapping spans count as one of the first's kind."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if start >= done:
            out += [text[done:start], MARKS[kind]]
        done = max(done, end)
    return "".join(out) + text[done:]


def _sanitise(text_at: int, chars_at: int | None, found_at: int | None):
    def sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            found = batch.column(found_at).to_pylist() if found_at is not None else [None] * len(texts)
            out = []
            for text, more in zip(texts, found, strict=True):
                if text is not None:
                    spans = [(k, a, b) for k, a, b, _ in base_spans(text)]
                    spans += [(s["kind"], s["start"], s["end"]) for s in more or []]
                    text = sanitised(text, spans) if spans else text
                out.append(text)
            columns = list(batch.columns)
            columns[text_at] = pa.array(out, batch.schema.field(text_at).type)
            if chars_at is not None:
                sizes = [before if a == b else len(b) for a, b, before in zip(texts, out, batch.column(chars_at).to_pylist(), strict=True)]
                columns[chars_at] = pa.array(sizes, batch.schema.field(chars_at).type)
            names = batch.schema.names
            if found_at is not None:
                columns, names = columns[:found_at], names[:found_at]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return sanitise


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """The rows and columns of docs, with personal data and disclosing terms replaced in ``text``,
    and ``n_chars``, if it is a column, counted anew where the text has changed."""
    told = disclosures(docs, generalise, remove)
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    key, more = free_name(docs, "key_of_text"), free_name(docs, "found_in_text")
    keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit(""))))
    known = key_filter(told.found.select(F.xxhash64("text_key").alias("hash")), "hash")
    plain = rows_in_filter(keyed, key, known, wanted=False).select(docs.columns)
    found = told.found.select(F.col("text_key").alias(key), F.col("found").alias(more))
    marked = rows_in_filter(keyed, key, known).join(found, key, "left").select(*docs.columns, more)
    plain = plain.mapInArrow(_sanitise(text_at, chars_at, None), docs.schema)
    return plain.unionByName(marked.mapInArrow(_sanitise(text_at, chars_at, len(docs.columns)), docs.schema))
