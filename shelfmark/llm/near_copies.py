"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A sketch of a text is the few least of its word k-mers under a random order, read in text order;
k-mers carry the number of their occurrence, so repetition and order both count. Documents that
share sketches are candidates, and a candidate pair is a link if its word edit distance, found
within a band, is at most ``1 - similarity`` of the longer text.

Equal texts are one node from the start. The texts of a sketch are not expanded into all pairs:
each is first aligned with the least text of one of its buckets, then with the least texts of
all. What remains are pairs of a bucket that are not connected by then. In a small bucket these
are aligned as they are. In a larger one, as a common passage makes it, texts meet only if they
also share one of their rarest words: two texts within the distance have most words in common,
so each of them must have a common word among a few of its own, in any order of the words. They
meet once, at the first of these, and only if enough words follow it in both texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.alignment import near
from shelfmark.llm.components import components
from shelfmark.llm.order_sketch import order_sketches
from shelfmark.llm.words import U64, Words, mix, occurrences, word_slices
from shelfmark.llm.work import (
    durable,
    key_filter,
    only_rows,
    rows_in_filter,
    small_batches,
    without_rows,
)

SHINGLE = 5
PICKED = 2
SKETCHES = 64
SIMILARITY = 0.8
#: Buckets of up to so many texts are joined with themselves as they are.
SMALL_BUCKET = 16
#: Words are ordered by counts in so many slots, then by hash: any order serves, if all share it.
COUNT_SLOTS = 2**18
#: And a rare word whose slots, for the lengths that a linked text may have, hold texts of one label
#: only leads nowhere. Lengths are told apart in classes, each so many times as long as the one before.
SINGLE_SLOTS = 2**26
CLASS_RATIO = 1.25
#: Words of a text are counted in so many bins, to tell unlike texts apart before they are aligned.
BINS = 256
SKETCH_SCHEMA = "doc_id long, key_a long, key_b long, n_words long, sketches array<long>, bins binary"
RARE_SCHEMA = "node long, rare array<long>, n long, label long"
WORD_SCHEMA = "node long, label long, n long, left long, key long, before array<long>"
EDGE_SCHEMA = "a long, b long"
RIGHT = {"node": "b", "n": "m", "label": "label_b", "left": "left_b", "before": "before_b"}


def _text_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the word sequence of each row; zeros if it has no words."""
    offsets = words.offsets()
    counts = np.diff(offsets)
    some = np.flatnonzero(counts)
    keys = np.zeros((2, words.rows), U64)
    if len(some):
        place = (np.arange(len(words.doc)) - offsets[words.doc]).astype(U64)
        for i, seed in enumerate((0x632BE59BD9B4E019, 0x8CB92BA72F3D8DD7)):
            tagged = mix(words.hashes ^ mix(place + U64(seed)))
            keys[i, some] = np.add.reduceat(tagged, offsets[some])
    return keys[0], keys[1]


def _bins(words: Words) -> np.ndarray:
    """How many words of each row fall into each bin, up to 255."""
    at = words.doc * BINS + (words.hashes % U64(BINS)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=words.rows * BINS), 255).astype(np.uint8).reshape(words.rows, BINS)


def _near_bins(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs whose bins do not rule them out: an edit moves one word, so it changes the bins by
    two at most, and by less where they are full."""

    def near_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            a, b = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(n, BINS).astype(np.int16) for i in (2, 4)
            )
            longer = np.maximum(batch.column(3).to_numpy(False), batch.column(5).to_numpy(False))
            apart = np.abs(a - b).sum(axis=1, dtype=np.int64)
            yield batch.select([0, 1]).filter(pa.array(apart <= 2 * ((1 - similarity) * longer + 1e-6)))

    return near_bins


def _sketch(k: int, picked: int, sketches: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_slices(batch.column(1)):
                key_a, key_b = _text_keys(words)
                bins = _bins(words)
                keys = order_sketches(words, k, picked, sketches)
                edges = np.arange(words.rows + 1, dtype=np.int32) * sketches
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.first_row, words.rows),
                        pa.array(key_a.view(np.int64)),
                        pa.array(key_b.view(np.int64)),
                        pa.array(words.counts().astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(edges), pa.array(keys.reshape(-1).view(np.int64))),
                        pa.array([row.tobytes() for row in bins], pa.binary()),
                    ],
                    names=["doc_id", "key_a", "key_b", "n_words", "sketches", "bins"],
                )

    return sketch


def _labelled(words: Words) -> np.ndarray:
    """A hash of each word with the number of its earlier occurrences in the same text."""
    labels = occurrences(mix(words.hashes ^ mix(words.doc.astype(U64) + U64(1))))
    return mix(words.hashes + labels.astype(U64) * U64(0xD1B54A32D192ED03))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words of all texts fall into each slot."""
    counts = np.zeros(COUNT_SLOTS, np.int64)
    for batch in batches:
        for words in word_slices(batch.column(1)):
            counts += np.bincount((_labelled(words) % U64(COUNT_SLOTS)).astype(np.int64), minlength=COUNT_SLOTS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])


def _parts(rare: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rare words of a batch of texts one by one: key, row, and place in the order of the row."""
    keys = rare.column(1).flatten().to_numpy(False)
    sizes = rare.column(1).value_lengths().to_numpy(False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return keys, row, np.arange(len(keys)) - (np.cumsum(sizes) - sizes)[row]


def _word_slots(keys: np.ndarray, n: np.ndarray, left: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The slots of each word: one for each class of lengths from that of its text to that of the
    longest text which may have the words left in common with it. Two linkable texts, at their
    first common word, have a slot in common. Also where the slots of each word begin."""
    low, high = (
        np.floor(np.log(x) / np.log(CLASS_RATIO)).astype(np.int64) for x in (n, np.maximum(n, left / similarity + 1e-6))
    )
    classes = high - low + 1
    first = np.cumsum(classes) - classes
    at = np.repeat(np.arange(len(keys)), classes)
    number = (low[at] + np.arange(len(at)) - first[at]).astype(U64)
    return (mix(keys.view(U64)[at] + number * U64(0xD1B54A32D192ED03)) % U64(SINGLE_SLOTS)).astype(np.int64), first


def _label_slots(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The least and the greatest label of the rare words that fall into each slot."""

    def label_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, row, place = _parts(batch)
            n = batch.column(2).to_numpy(False)[row]
            slots, begun = _word_slots(keys, n, n - place, similarity)
            labels = np.repeat(batch.column(3).to_numpy(False)[row], np.diff(np.append(begun, len(slots))))
            order = np.lexsort((labels, slots))
            slots, labels = slots[order], labels[order]
            first = np.flatnonzero(np.diff(slots, prepend=-1))
            last = np.append(first, len(slots))[1:] - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots[first]), pa.array(labels[first]), pa.array(labels[last])], names=["slot", "low", "high"]
            )

    return label_slots


def _repeated(shared: Broadcast, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each rare word by which a text may meet one of another label, with how many words
    of the text are left from it on, and those of its rows that come before."""

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, row, place = _parts(batch)
            if not len(keys):
                continue
            n = batch.column(2).to_numpy(False)[row]
            slots, begun = _word_slots(keys, n, n - place, similarity)
            met = (shared.value[slots >> 6] >> (slots & 63).astype(U64)) & U64(1)
            keep = np.maximum.reduceat(met, begun) > 0
            keys, row, place, n = keys[keep], row[keep], place[keep], n[keep]
            kept = np.bincount(row, minlength=batch.num_rows)
            first = (np.cumsum(kept) - kept)[row]
            before = np.arange(len(keys)) - first
            edges = np.concatenate([[0], np.cumsum(before)]).astype(np.int32)
            earlier = np.repeat(first - edges[:-1], before) + np.arange(edges[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column(0).to_numpy(False)[row]),
                    pa.array(batch.column(3).to_numpy(False)[row]),
                    pa.array(n),
                    pa.array(n - place),
                    pa.array(keys),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(keys[earlier])),
                ],
                names=["node", "label", "n", "left", "key", "before"],
            )

    return repeated


def _rarest(counts: Broadcast, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys of the rarest words of each text, as many as it may differ in from a text it is linked
    to, and one more; and the number of all its words."""

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_slices(batch.column(1)):
                keys = _labelled(words)
                n = words.counts()
                order = np.lexsort((keys, counts.value[(keys % U64(COUNT_SLOTS)).astype(np.int64)], words.doc))
                place = np.arange(len(keys)) - words.offsets()[words.doc]
                wanted = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
                keep = place < wanted[words.doc]
                edges = np.concatenate([[0], np.cumsum(np.minimum(wanted, n))]).astype(np.int32)
                rare = keys[order][keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.first_row, words.rows),
                        pa.ListArray.from_arrays(pa.array(edges), pa.array(rare.view(np.int64))),
                        pa.array(n.astype(np.int64)),
                        *(column.slice(words.first_row, words.rows) for column in batch.columns[2:]),
                    ],
                    names=["node", "rare", "n", *batch.schema.names[2:]],
                )

    return rarest


def rare_words(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rarest words (``key``) of each text of a table (doc_id, text, label), without those that
    only texts of one label, or of other lengths, have. Two texts of unlike labels whose word edit
    similarity reaches the threshold share one. At most ``SINGLE_SLOTS`` / 64 rows reach the driver."""
    context = texts.sparkSession.sparkContext
    counted = texts.mapInArrow(_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNT_SLOTS, np.int64)
    counts[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    rare = durable(texts.mapInArrow(_rarest(context.broadcast(counts), similarity), RARE_SCHEMA))
    ends = rare.mapInArrow(_label_slots(similarity), "slot long, low long, high long").groupBy("slot")
    ends = ends.agg(F.min("low").alias("low"), F.max("high").alias("high")).filter(F.col("low") < F.col("high"))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    several = ends.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    shared = np.zeros(SINGLE_SLOTS // 64, U64)
    shared[several["at"].to_numpy()] = several["bits"].to_numpy().view(U64)
    return durable(rare.mapInArrow(_repeated(context.broadcast(shared), similarity), WORD_SCHEMA))


def _pairs_by_word(rare: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of unlike labels that share a rare word, each at the first one they share, if
    the words from there on can be as many as two linked texts have in common."""
    right = rare.select([F.col(c).alias(RIGHT.get(c, c)) for c in rare.columns])
    found = rare.join(right, "key").filter(
        (F.col("node") < F.col("b"))
        & (F.col("label") != F.col("label_b"))
        & (F.least("left", "left_b") >= F.greatest("n", "m") * similarity - 1e-9)
        & ~F.arrays_overlap("before", "before_b")
    )
    return found.select(F.col("node").alias("a"), "b")


def _align(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, list[bytes]] = ("", [])
        for batch in batches:
            linked = []
            for i in range(batch.num_rows):
                text = batch.column(3)[i].as_py()
                if text != last[0]:
                    last = (text, text.encode().split())
                if near(batch.column(2)[i].as_py().encode().split(), last[1], similarity):
                    linked.append(i)
            yield batch.select([0, 1]).take(pa.array(linked, pa.int64()))

    return align


def _alike(n: Column, m: Column, similarity: float) -> Column:
    """Whether lengths alone allow the similarity."""
    return F.least(n, m) >= F.greatest(n, m) * similarity - 1e-9


def _apart(rows: DataFrame) -> DataFrame:
    """The rows of buckets (``key``) that hold more than one label."""
    split = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    split = split.filter(F.col("low") < F.col("high")).select("key").hint("rebalance")
    return rows.join(split, "key").select(rows.columns)


def near_copies(
    docs: DataFrame,
    k: int = SHINGLE,
    picked: int = PICKED,
    sketches: int = SKETCHES,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``doc_id`` and ``class_id`` of every row: the least doc_id among the documents connected
    to it by links.

    Words are lower-cased and stand between blanks. Two texts are linked if their edit similarity
    is at least ``similarity`` and they share one of ``sketches`` sketches of ``picked`` k-mers.
    Equal word sequences always are. With J the share of common k-mers, a linkable pair shares
    no sketch with probability ``(1 - J**picked)**sketches``; where a share w of the words is
    changed at random places, J is about ``(1 - w)**k / (2 - (1 - w)**k)``. Null texts are empty, and
    texts without words are linked to nothing. Rows that share an id are one document. A row with
    a null id gets the class of its text's copies, or null; it links nothing. An empty table gives
    no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text")
    )
    table = durable(rows.mapInArrow(_sketch(k, picked, sketches), SKETCH_SCHEMA))
    real = table.filter((F.col("n_words") > 0) & F.col("doc_id").isNotNull())
    nodes = durable(
        real.groupBy("key_a", "key_b").agg(
            F.min("doc_id").alias("node"),
            F.first("n_words").alias("n"),
            F.first("sketches").alias("sketches"),
            F.first("bins").alias("bins"),
        )
    )
    buckets = nodes.select("node", "n", F.explode("sketches").alias("key"))
    heads = durable(
        buckets.groupBy("key")
        .agg(F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("size"))
        .filter(F.col("size") > 1)
        .select("key", F.col("head.node").alias("head"), F.col("head.n").alias("head_n"))
    )
    hits = durable(buckets.join(heads, "key"))
    ids = hits.select("node").distinct().select("node", F.xxhash64("node").alias("hash"))
    known = key_filter(ids, "hash")
    texts = durable(rows_in_filter(rows.filter(F.col("doc_id").isNotNull()), "doc_id", known))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose texts align; b, the side that repeats, is joined last."""
        binned = nodes.select("node", "bins", "n")
        pairs = pairs.join(binned.toDF("a", "bins_a", "n"), "a").join(binned.toDF("b", "bins_b", "m"), "b")
        pairs = pairs.select("a", "b", "bins_a", "n", "bins_b", "m").mapInArrow(_near_bins(similarity), EDGE_SCHEMA)
        pairs = durable(pairs.distinct())
        named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = key_filter(named.select(F.xxhash64("id").alias("hash")), "hash")
        some = rows_in_filter(texts, "doc_id", wanted)
        side_a = some.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        side_b = some.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(side_a, "a").join(side_b, "b").select("a", "b", "text_a", "text_b")
        return durable(both.mapInArrow(_align(similarity), EDGE_SCHEMA))

    def with_labels(table: DataFrame, node: str, label: str, labels: DataFrame) -> DataFrame:
        named = labels.select(F.col("node").alias(node), F.col("label").alias(label))
        return table.join(named, node, "left").withColumn(label, F.coalesce(label, node))

    to_head = hits.filter((F.col("node") != F.col("head")) & _alike(F.col("n"), F.col("head_n"), similarity))
    first = durable(to_head.groupBy(F.col("node").alias("a")).agg(F.min("head").alias("b")))
    edges = verified(first)
    labels = durable(components(edges))

    apart = to_head.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    apart = with_labels(with_labels(apart, "a", "label_a", labels), "b", "label_b", labels)
    edges = edges.unionByName(verified(apart.filter(F.col("label_a") != F.col("label_b")).select("a", "b")))
    labels = durable(components(edges))

    marked = with_labels(hits, "node", "label", labels).filter(F.col("node") != F.col("head"))
    parted = durable(_apart(marked.select("key", "node", "n", "label")))
    large = parted.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > SMALL_BUCKET).select("key")
    large = durable(large)
    met = durable(
        parted.join(large, "key").groupBy("node", "n", "label").agg(F.collect_list("key").alias("keys"))
    )
    nodes_met = met.select(F.xxhash64("node").alias("hash")).distinct()
    texts_met = rows_in_filter(texts, "doc_id", key_filter(nodes_met, "hash"))
    # Dealt by id: texts of a common passage may stand together in the table.
    named = met.select(F.col("node").alias("doc_id"), "label").distinct()
    texts_met = durable(texts_met.repartition("doc_id").join(named, "doc_id").select("doc_id", "text", "label"))
    # A common passage is no key of this join, as one of its rarest words a text is not.
    rare = rare_words(texts_met, similarity)
    few = parted.join(large, "key", "left_anti")

    def pairs_of(left: DataFrame) -> DataFrame:
        right = left.select([F.col(c).alias(RIGHT.get(c, c)) for c in left.columns])
        found = left.join(right, "key").filter((F.col("node") < F.col("b")) & (F.col("label") != F.col("label_b")))
        return found.filter(_alike(F.col("n"), F.col("m"), similarity)).select(F.col("node").alias("a"), "b").distinct()

    # Those that met by a word must have a bucket in common as well.
    held = met.select("node", "keys")
    by_word = _pairs_by_word(rare, similarity).join(held.toDF("a", "keys_a"), "a").join(held.toDF("b", "keys_b"), "b")
    by_word = by_word.filter(F.arrays_overlap("keys_a", "keys_b")).select("a", "b")
    rest = pairs_of(few).unionByName(by_word).distinct()
    edges = edges.unionByName(verified(rest))
    labels = durable(components(edges))

    classes = with_labels(nodes.select("key_a", "key_b", "node"), "node", "label", labels).drop("node")
    named = table.join(durable(classes), ["key_a", "key_b"], "left")
    return named.select(
        "doc_id", F.when(F.col("n_words") > 0, F.col("label")).otherwise(F.col("doc_id")).alias("class_id")
    )


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay when one document of each class does: the one with the least
    doc_id. Of rows that share that id the least by text stays; rows without an id all stay."""
    named = near_copies(docs, **options).filter(F.col("doc_id").isNotNull())
    ids = durable(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"), F.min("class_id").alias("class_id")))
    stays = F.col("doc_id") == F.col("class_id")
    repeated = ids.filter(stays & (F.col("copies") > 1)).select("doc_id")
    other = ids.filter(~stays | (F.col("copies") > 1)).select("doc_id")
    columns = [c for c in docs.columns if c not in ("text", "doc_id")]
    least = (
        only_rows(docs, repeated, "doc_id")
        .groupBy("doc_id")
        .agg(F.min(F.struct("text", *columns)).alias("row"))
        .select("doc_id", "row.*")
        .select(docs.columns)
    )
    return without_rows(docs, other, "doc_id").unionByName(least)
