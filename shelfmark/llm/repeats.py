"""Substring dedup by fixed-block anchors.

1. Every document's non-overlapping blocks of ``BLOCK`` words are the index; every rolling window
   of ``BLOCK`` words probes it. A run of ``window`` words holds a whole block of its document if
   ``window >= 2 * BLOCK - 1``, so a repeat of that length meets at least one anchor: a block
   that recurs in another document. Each slice of documents sends its distinct hashes, sorted and
   delta-coded, to the task that holds their range; a passage that stands in very many documents
   counts once a slice.
2. Anchors become a filter of fixed size. It picks the windows near an anchor hit (a filter too
   full picks more of them, never fewer), and the documents that have any.
3. Hits are extended to all windows that hold them: for each distinct window of a slice, its range
   task finds the smallest document and answers the slice. Windows of larger documents, joined
   where they overlap, are the maximal repeats.

Windows are compared by 80 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.words import U64, Words, mix, ngram_hashes, ngram_starts, word_slices
from shelfmark.llm.work import durable, held, key_filter, small_batches

WINDOW = 13
BLOCK = 7
SLICE = 4 * 2**20
RANGE_BYTES = 3 * 2**20
ANCHOR_FILTER_BITS = 27

ANCHOR_SCHEMA = "bucket int, probes binary, shared binary, blocks binary"
SPLIT_SCHEMA = (
    "unit long, doc_id long, text string, n_words long, n_removed long, removed array<struct<start:long,end:long>>, "
    "kept_sha256 string, kept string"
)
RESULT_SCHEMA = (
    "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_sha256 string, kept string"
)
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ENTRY_SCHEMA = "bucket int, unit long, hashes binary, checks binary, least binary, spread binary"
ANSWER_SCHEMA = "unit long, hashes binary, checks binary, least binary"


def encoded(values: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed. Small values cost little."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    raw = np.ascontiguousarray(planes).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def decoded(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if size == 0:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def encoded_sorted(values: np.ndarray) -> bytes:
    return encoded(np.diff(values, prepend=U64(0)))


def decoded_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(decoded(data, np.uint64), dtype=np.uint64)


def _edges(hashes: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where the ranges of sorted hashes begin; one entry more than ranges."""
    bounds = [((i << bits) + buckets - 1) // buckets for i in range(1, buckets)]
    inner = np.searchsorted(hashes, np.array(bounds, np.uint64), side="left")
    return np.concatenate([[0], inner, [len(hashes)]]).astype(np.int64)


def anchor_bits(total: int) -> int:
    """Bits of an anchor's hash: with ten more than the number of texts' bytes has, about one
    window in several thousand meets another by chance, whatever the size of the corpus."""
    return min(62, max(24, total.bit_length() + 10))


def _anchors(buckets: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_slices(batch.column(0), SLICE):
                starts = ngram_starts(words, BLOCK)
                if not len(starts):
                    continue
                hashes = ngram_hashes(words.hashes, BLOCK)[starts] >> U64(64 - bits)
                docs = words.doc[starts]
                aligned = (starts - words.offsets()[docs]) % BLOCK == 0
                blocks = np.unique(hashes[aligned])
                order = np.argsort(hashes, kind="stable")
                hashes, docs = hashes[order], docs[order]
                begin = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
                last = np.r_[begin[1:], len(hashes)] - 1
                probes = hashes[begin]
                shared = probes[docs[begin] != docs[last]]
                parts = [(v, _edges(v, bits, buckets)) for v in (probes, shared, blocks)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(buckets), pa.int32())]
                    + [
                        pa.array([encoded_sorted(v[e[i] : e[i + 1]]) for i in range(buckets)], pa.binary())
                        for v, e in parts
                    ],
                    names=["bucket", "probes", "shared", "blocks"],
                )

    return anchors


def _recurring(table: pa.Table) -> pa.Table:
    """Blocks of a range that stand in at least two documents, as keys of a filter."""

    def all_of(name: str) -> np.ndarray:
        parts = [decoded_sorted(x) for x in table[name].to_pylist()]
        return np.concatenate(parts) if parts else np.zeros(0, U64)

    probes = np.sort(all_of("probes"))
    repeated = probes[1:][probes[1:] == probes[:-1]]
    found = np.intersect1d(np.concatenate([repeated, all_of("shared")]), all_of("blocks"))
    return pa.table({"anchor": pa.array(mix(found).view(np.int64))})


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and second hashes of all windows."""
    starts = ngram_starts(words, window)
    hashes = ngram_hashes(words.hashes, window)[starts]
    checks = (ngram_hashes(words.hashes, window, seed=1)[starts] >> U64(48)).astype(np.uint16)
    return starts, hashes, checks


def _result(words: Words, row: int, begin: int, end: int, covered: np.ndarray | None, texts: bool) -> tuple:
    """n_words, n_removed, removed runs, digest and (if wanted) text of what is kept."""
    data = words.data.tobytes() if not isinstance(words.data, bytes) else words.data
    keep = range(begin, end) if covered is None else begin + np.flatnonzero(~covered[begin:end])
    start, stop = words.start, words.end
    kept = b" ".join([data[start[i] : stop[i]] for i in keep])
    runs = []
    if covered is not None:
        edge = np.flatnonzero(np.diff(np.r_[False, covered[begin:end], False]))
        runs = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
    return end - begin, end - begin - len(keep), runs, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None


def _split(known: Broadcast, bits: int, window: int, texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Results of documents without a window near an anchor; texts of the others, with the
    slice that they belong to."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        for batch in batches:
            for words in word_slices(batch.column(1), SLICE):
                unit += 1
                near = ngram_starts(words, window)[_near_windows(words, known.value, bits, window)]
                some = np.zeros(words.rows, dtype=bool)
                some[words.doc[near]] = True
                words.data = words.data.tobytes()
                offsets = words.offsets()
                rows = []
                for row in range(words.rows):
                    at = words.first_row + row
                    doc_id = batch.column(0)[at].as_py()
                    begin, end = int(offsets[row]), int(offsets[row + 1])
                    if some[row] and doc_id is not None:
                        rows.append((unit, doc_id, batch.column(1)[at].as_py(), end - begin, None, None, None, None))
                    else:
                        rows.append((unit, doc_id, None, *_result(words, row, begin, end, None, texts)))
                yield _batch(rows, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), SPANS, pa.string(), pa.string()],
                             ["unit", "doc_id", "text", "n_words", "n_removed", "removed", "kept_sha256", "kept"])

    return split


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _near_windows(words: Words, known: np.ndarray, bits: int, window: int) -> np.ndarray:
    """Which windows hold a probe that hits an anchor."""
    hits = np.zeros(len(words.doc) + 1, np.int64)
    starts = ngram_starts(words, BLOCK)
    hits[starts + 1] = held(known, mix(ngram_hashes(words.hashes, BLOCK)[starts] >> U64(64 - bits)))
    hits = np.cumsum(hits)
    starts = ngram_starts(words, window)
    return hits[starts + window - BLOCK + 1] > hits[starts]


def _entries(known: Broadcast, bits: int, window: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The distinct windows near an anchor, of the rows of one slice, with the smallest document
    that holds each and how far the largest lies above it."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(0).to_numpy()
            edges = np.r_[0, np.flatnonzero(units[1:] != units[:-1]) + 1, len(units)] if len(units) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                ids = batch.column(1).slice(a, b - a).to_numpy()
                for words in word_slices(batch.column(2).slice(a, b - a), SLICE):
                    starts, hashes, checks = _windows(words, window)
                    near = _near_windows(words, known.value, bits, window)
                    starts, hashes, checks = starts[near], hashes[near], checks[near]
                    if not len(starts):
                        continue
                    docs = ids[words.first_row + words.doc[starts]]
                    order = np.lexsort((docs, checks, hashes))
                    hashes, checks, docs = hashes[order], checks[order], docs[order]
                    begin = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])])
                    last = np.r_[begin[1:], len(hashes)] - 1
                    hashes, checks = hashes[begin], checks[begin]
                    least = docs[begin]
                    # as unsigned, so that no difference of two longs overflows
                    spread = docs[last].view(np.uint64) - least.view(np.uint64)
                    e = _edges(hashes, 64, buckets)
                    parts = [(i, slice(e[i], e[i + 1])) for i in range(buckets) if e[i] < e[i + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([i for i, _ in parts], pa.int32()),
                            pa.array([int(units[a])] * len(parts), pa.int64()),
                            pa.array([encoded_sorted(hashes[s]) for _, s in parts], pa.binary()),
                            pa.array([encoded(checks[s]) for _, s in parts], pa.binary()),
                            pa.array([encoded(least[s]) for _, s in parts], pa.binary()),
                            pa.array([encoded(spread[s]) for _, s in parts], pa.binary()),
                        ],
                        names=["bucket", "unit", "hashes", "checks", "least", "spread"],
                    )

    return entries


def _answers(table: pa.Table) -> pa.Table:
    """For each slice its windows that begin in a smaller document too, and the smallest one."""
    units = table["unit"].to_pylist()
    hashes = [decoded_sorted(x) for x in table["hashes"].to_pylist()]
    sizes = np.array([len(h) for h in hashes])
    of = np.repeat(np.arange(len(units)), sizes)
    hashes = np.concatenate(hashes)
    checks = np.concatenate([decoded(x, np.uint16) for x in table["checks"].to_pylist()])
    least = np.concatenate([decoded(x, np.int64) for x in table["least"].to_pylist()])
    spread = np.concatenate([decoded(x, np.uint64) for x in table["spread"].to_pylist()])
    most = (least.view(np.uint64) + spread).view(np.int64)
    order = np.lexsort((checks, hashes))
    hashes, checks, least, most, of = (x[order] for x in (hashes, checks, least, most, of))
    fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])]
    begin = np.flatnonzero(fresh)
    smallest = np.minimum.reduceat(least, begin)[np.cumsum(fresh) - 1]
    told = np.flatnonzero(smallest < most)
    told = told[np.argsort(of[told], kind="stable")]
    hashes, checks, smallest, of = hashes[told], checks[told], smallest[told], of[told]
    edges = np.searchsorted(of, np.arange(len(units) + 1))
    rows = [
        (units[i], encoded_sorted(hashes[a:b]), encoded(checks[a:b]), encoded(smallest[a:b]))
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
        if a < b
    ]
    return pa.Table.from_batches(
        [_batch(rows, [pa.int64(), pa.binary(), pa.binary(), pa.binary()], ["unit", "hashes", "checks", "least"])]
    )


def _smaller(answers: tuple, hashes: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which windows begin in a document smaller than their own."""
    known, known_checks, least = answers
    found = np.zeros(len(hashes), dtype=bool)
    if not len(known):
        return found
    at = np.searchsorted(known, hashes)
    for _ in range(int(np.bincount(np.cumsum(np.r_[True, known[1:] != known[:-1]])).max())):
        inside = np.minimum(at, len(known) - 1)
        found |= (at < len(known)) & (known[inside] == hashes) & (known_checks[inside] == checks) & (least[inside] < docs)
        at = at + 1
    return found


def _removed(window: int, texts: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes = [decoded_sorted(x) for x in right["hashes"].to_pylist()]
        answers = (np.zeros(0, U64), np.zeros(0, np.uint16), np.zeros(0, np.int64))
        if hashes:
            known = np.concatenate(hashes)
            checks = np.concatenate([decoded(x, np.uint16) for x in right["checks"].to_pylist()])
            least = np.concatenate([decoded(x, np.int64) for x in right["least"].to_pylist()])
            order = np.argsort(known, kind="stable")
            answers = (known[order], checks[order], least[order])
        ids = left["doc_id"].to_numpy()
        rows = []
        for words in word_slices(left["text"].combine_chunks(), SLICE):
            starts, found, checks = _windows(words, window)
            docs = ids[words.first_row + words.doc]
            hit = starts[_smaller(answers, found, checks, docs[starts])]
            step = np.zeros(len(words.doc) + 1, np.int64)
            np.add.at(step, hit, 1)
            np.add.at(step, hit + window, -1)
            covered = np.cumsum(step)[:-1] > 0
            words.data = words.data.tobytes()
            offsets = words.offsets()
            for row in range(words.rows):
                begin, end = int(offsets[row]), int(offsets[row + 1])
                rows.append((int(ids[words.first_row + row]), *_result(words, row, begin, end, covered, texts)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), SPANS, pa.string(), pa.string()]
        names = ["doc_id", "n_words", "n_removed", "removed", "kept_sha256", "kept"]
        return pa.Table.from_batches([_batch(rows, kinds, names)])

    return removed


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Take out of each document the words covered by a run of ``window`` words that also
    begins in a document with a smaller doc_id; runs are judged on the input.

    Words are the runs of characters other than space and \\x09-\\x0d, as they stand. Returns
    ``doc_id``, ``n_words``, ``n_removed``, ``removed`` (word numbers from 0 of the maximal
    repeats, end exclusive), ``kept_sha256`` (hex digest of the kept words, joined by a space) and
    ``kept`` (those words; null unless ``texts``). Null texts are empty; rows with a null id
    lose nothing and cause no loss; rows that share an id do not count against each other. An
    empty table gives no rows; other columns are ignored.
    """
    if window < 2 * BLOCK - 1:
        raise ValueError(f"a window needs at least {2 * BLOCK - 1} words")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, bits = max(1, total // RANGE_BYTES), anchor_bits(total)
    anchors = (
        rows.select("text").mapInArrow(_anchors(buckets, bits), ANCHOR_SCHEMA).groupBy("bucket").applyInArrow(_recurring, "anchor long")
    )
    known = key_filter(anchors, "anchor", ANCHOR_FILTER_BITS)
    table = durable(rows.mapInArrow(_split(known, bits, window, texts), SPLIT_SCHEMA))
    near = table.filter(F.col("text").isNotNull()).select("unit", "doc_id", "text")
    answers = (
        near.mapInArrow(_entries(known, bits, window, buckets), ENTRY_SCHEMA).groupBy("bucket").applyInArrow(_answers, ANSWER_SCHEMA)
    )
    mended = near.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_removed(window, texts), RESULT_SCHEMA)
    whole = table.filter(F.col("text").isNull()).select(mended.columns)
    return whole.unionByName(mended)
