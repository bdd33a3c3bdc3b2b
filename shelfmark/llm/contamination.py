"""Benchmark decontamination: MinHash containment search, partitioned by size, verified exactly.

Documents are partitioned by their number of distinct shingles, in powers of two. A document's
sketch is a one-permutation MinHash: the hash range is cut into bins, whose number follows from
the document's partition and the smallest test item, and the least shingle hash of each bin is
kept. Test items are indexed by their shingle hashes. A document that contains the share
``containment`` of an item keeps each of these shingles as its bin's least one with probability
about 1 - load / 2, and the load of the bins is set so that missing all of them is less probable
than ``MISS`` even for the smallest item. Whatever is found is verified on the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.words import U64, ngram_hashes, ngram_starts, word_slices
from shelfmark.llm.work import durable, held, key_filter, rows_in_filter, small_batches

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-6
INDEX_SCHEMA = "item_id long, shingle long, shingles int"
SKETCH_SCHEMA = "doc_id long, shingle long"
PAIR_SCHEMA = "doc_id long, item_id long, shared long, item_shingles long"


def _index(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for words in word_slices(batch.column(1)):
                starts = ngram_starts(words, width)
                hashes = ngram_hashes(words.hashes, width)[starts]
                docs = words.doc[starts]
                out: list[tuple[int, np.ndarray]] = [
                    (names[words.first_row + row], np.unique(hashes[docs == row])) for row in np.unique(docs)
                ]
                if out:
                    sizes = [len(h) for _, h in out]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat([n for n, _ in out], sizes), pa.int64()),
                            pa.array(np.concatenate([h for _, h in out]).view(np.int64)),
                            pa.array(np.repeat(sizes, sizes).astype(np.int32)),
                        ],
                        names=["item_id", "shingle", "shingles"],
                    )

    return index


def bin_minima(docs: np.ndarray, hashes: np.ndarray, finer: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each least hash of a bin; a row of u distinct hashes has
    2**(ceil(log2 u) + finer) bins over the range of hashes."""
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    fresh = np.ones(len(docs), dtype=bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    docs, hashes = docs[fresh], hashes[fresh]
    if not len(docs):
        return docs, hashes
    sizes = np.bincount(docs)
    partition = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    bits = np.clip(partition + finer, 1, 63)[docs]
    bins = hashes >> (64 - bits).astype(U64)
    least = np.ones(len(docs), dtype=bool)
    least[1:] = (docs[1:] != docs[:-1]) | (bins[1:] != bins[:-1])
    return docs[least], hashes[least]


def _sketch(width: int, finer: int, known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy(False)
            for words in word_slices(batch.column(1)):
                starts = ngram_starts(words, width)
                docs, hashes = bin_minima(words.doc[starts], ngram_hashes(words.hashes, width)[starts], finer)
                found = held(known.value, hashes)
                if found.any():
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names[words.first_row + docs[found]].astype(np.int64)),
                            pa.array(hashes[found].view(np.int64)),
                        ],
                        names=["doc_id", "shingle"],
                    )

    return sketch


def shingle_set(text: str, width: int = SHINGLE) -> set[tuple[bytes, ...]]:
    words = text.encode().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def _verify(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[str, set] = {}
        last: tuple[str, set] = ("", set())
        for batch in batches:
            rows = []
            for doc_id, item_id, text, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text != last[0]:
                    last = (text, shingle_set(text, width))
                if item not in items:
                    if len(items) >= 4096:
                        items.clear()
                    items[item] = shingle_set(item, width)
                wanted = items[item]
                rows.append((doc_id, item_id, len(wanted & last[1]), len(wanted)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4,
                names=["doc_id", "item_id", "shared", "item_shingles"],
            )

    return verify


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    containment: float = CONTAINMENT,
    width: int = SHINGLE,
) -> DataFrame:
    """Pairs of a document and a test item of whose distinct shingles (``width`` lower-cased
    words) the document holds at least the share ``containment``, anywhere in its whole text:
    ``doc_id``, ``item_id``, ``shared``, ``item_shingles``, ``containment``.

    Words are what stands between blanks. Items of fewer words than a shingle match nothing.
    Null texts are empty; rows with a null id take no part. Rows that share an id give one row
    per pair, with the most shared. Empty tables give no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("doc_text")
    )
    items = benchmark.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.lower(F.coalesce("text", F.lit(""))).alias("item_text")
    )
    index = items.mapInArrow(_index(width), INDEX_SCHEMA)
    smallest = index.agg(F.min("shingles")).first()[0] or 1
    load = 2 * MISS ** (1 / (containment * smallest))
    finer = max(0, math.ceil(-math.log2(load)))
    sketches = texts.mapInArrow(_sketch(width, finer, key_filter(index, "shingle")), SKETCH_SCHEMA)
    pairs = durable(sketches.join(index, "shingle").select("doc_id", "item_id").distinct())
    named = pairs.withColumn("hash", F.xxhash64("doc_id"))
    likely = rows_in_filter(texts, "doc_id", key_filter(named, "hash"))
    return (
        pairs.join(likely, "doc_id")
        .join(items, "item_id")
        .select("doc_id", "item_id", "doc_text", "item_text")
        .mapInArrow(_verify(width), PAIR_SCHEMA)
        .filter((F.col("item_shingles") > 0) & (F.col("shared") >= F.col("item_shingles") * containment - 1e-9))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("shared", "item_shingles")).alias("best"))
        .select(
            "doc_id",
            "item_id",
            "best.shared",
            "best.item_shingles",
            (F.col("best.shared") / F.col("best.item_shingles")).alias("containment"),
        )
    )
