"""Phrase collocations by FM-indexes over word numbers, one per shard, summed over shards.

Texts are cut into pieces at punctuation, and pieces into words. A shard is a few megabytes of text
of one language, encoded once as word numbers. Phrases are counted length by length: each shard
builds a bidirectional FM-index over what may still be part of a frequent phrase (words between
rarer ones, then runs of frequent phrases one word shorter), extends the intervals of frequent
phrases by one word, and sends each longer phrase with its count once. Counts are summed over the
shards; those below the least count are dropped, as no longer phrase can be more frequent than
its parts. The frequent phrases reach the next pass as filters, which only ever let too much
through: counts are exact at every length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.fm_index import BidirectionalIndex
from shelfmark.llm.words import BASE, U64, _power_tables, mix, ngram_hashes, text_slices
from shelfmark.llm.work import batches_of_bytes, durable, held, key_filter

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
SHARD_BYTES = 2 * 2**20
#: Rows that go to Spark at once.
OUT_ROWS = 2**16
NO_LANGUAGE = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ENDS_PIECE = np.zeros(256, dtype=bool)
_ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_IN_WORD = ~_ENDS_PIECE
_IN_WORD[[0x20, 0x09]] = False

SHARD_SCHEMA = "lang string, keys array<long>, words array<string>, counts array<long>, ids array<int>"


def _encode(lang: str, offsets: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """A shard: its distinct words with their keys and counts, and its text as numbers of these
    words from 1, with a 0 between pieces and at both ends."""
    n = len(data)
    data = _LOWER[data]
    solid = np.zeros(n + 2, dtype=bool)
    solid[1:-1] = _IN_WORD[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    power, inverse = _power_tables(n)
    total = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[:n], out=total[1:])
    of_lang = U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    hashes = mix(mix((total[end] - total[start]) * inverse[start]) + of_lang)
    keys, first, ids, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    ended = np.cumsum(_ENDS_PIECE[data]) if n else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, start, side="right")
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (ended[start[1:]] != ended[start[:-1]]) | (row[1:] != row[:-1])
    sequence = np.zeros(len(start) + int(fresh.sum()) + 1, np.int32)
    sequence[np.arange(len(start)) + np.cumsum(fresh)] = ids + 1
    raw = data.tobytes()
    words = [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang]),
            pa.array([keys.view(np.int64)], pa.list_(pa.int64())),
            pa.array([words], pa.list_(pa.string())),
            pa.array([counts], pa.list_(pa.int64())),
            pa.array([sequence], pa.list_(pa.int32())),
        ],
        names=["lang", "keys", "words", "counts", "ids"],
    )


def _shards(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encode texts in shards of one language and about ``size`` bytes each."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).fill_null(NO_LANGUAGE).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(1).filter(pa.compute.equal(langs.indices, code))
                for _, offsets, data in text_slices(texts, size):
                    yield _encode(lang, offsets, data)

    return encode


def _joined(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of each phrase from the keys of its words; as ``ngram_hashes`` has it."""
    total = columns[0].copy()
    for column in columns[1:]:
        total *= U64(BASE)
        total += column
    return mix(total)


def _phrase_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [c.to_numpy(False).view(U64) for c in batch.columns]
        yield pa.RecordBatch.from_arrays([pa.array(_joined(columns).view(np.int64))], names=["hash"])


def _collapsed(ids: np.ndarray) -> np.ndarray:
    """One 0 between pieces and at both ends."""
    ids = np.concatenate([[0], ids, [0]])
    keep = np.ones(len(ids), dtype=bool)
    keep[1:] = (ids[1:] > 0) | (ids[:-1] > 0)
    return ids[keep]


def _left_in(ids: np.ndarray, keys: np.ndarray, filters: list[np.ndarray]) -> np.ndarray:
    """The sequence without what stands in no frequent phrase of the lengths that are known."""
    if not len(keys):
        return np.zeros(1, ids.dtype)
    ids = _collapsed(np.where(held(filters[0], mix(keys))[ids - 1] & (ids > 0), ids, 0))
    for length, table in enumerate(filters[1:], 2):
        if len(ids) < length:
            return np.zeros(1, ids.dtype)
        hashes = ngram_hashes(np.where(ids > 0, keys[ids - 1], U64(0)), length)
        ends = np.concatenate([[0], np.cumsum(ids == 0)])
        at = np.flatnonzero(ends[length:] == ends[:-length])
        at = at[held(table, hashes[at])]
        cover = np.zeros(len(ids) + 1, np.int64)
        cover[at] += 1
        cover[at + length] -= 1
        ids = _collapsed(np.where(np.cumsum(cover[:-1]) > 0, ids, 0))
    return ids


def _longer(filters: list[Broadcast]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Count the phrases one word longer than those of the last filter, shard by shard."""
    length = len(filters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [f.value for f in filters]
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column(1)[i].values.to_numpy(False).view(U64)
                ids = _left_in(batch.column(2)[i].values.to_numpy(False), keys, tables)
                if len(ids) < length + 2:
                    continue
                index = BidirectionalIndex(ids, length + 1)
                named = np.where(ids > 0, keys[ids - 1], U64(0))
                phrases = index.words()
                for known in range(1, length + 1):
                    # Grown at either end in turn; both parts one word shorter must be frequent.
                    phrases = index.extend_left(phrases) if known % 2 else index.extend_right(phrases)
                    at = index.places(phrases)
                    columns = [named[at + j] for j in range(known + 1)]
                    keep = held(tables[known - 1], _joined(columns[:-1])) & held(tables[known - 1], _joined(columns[1:]))
                    if known < length:
                        keep[keep] = held(tables[known], _joined([c[keep] for c in columns]))
                    phrases = phrases.only(keep)
                n = len(phrases.size)
                lang, columns = batch.column(0)[i].as_py(), [c[keep].view(np.int64) for c in columns]
                for at in range(0, n, OUT_ROWS):
                    some = slice(at, at + OUT_ROWS)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * min(OUT_ROWS, n - at), pa.string()),
                            *(pa.array(c[some]) for c in columns),
                            pa.array(phrases.size[some]),
                        ],
                        names=["lang", *_names(length + 1), "n"],
                    )

    return count


def _names(length: int) -> list[str]:
    return [f"w{i}" for i in range(1, length + 1)]


def _filter(grams: DataFrame, length: int) -> Broadcast:
    """The phrases as a filter whose size follows their number, 8 MB at most."""
    hashes = grams.select(*_names(length)).mapInArrow(_phrase_hash, "hash long")
    bits = max(16, min(26, (32 * grams.count()).bit_length()))
    return key_filter(hashes, "hash", bits)


def frequent_phrases(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, shard_bytes: int = SHARD_BYTES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: (lang, n), the number of words; (lang, key, word), the words that occur at least
    ``min_count`` times; (lang, words, a), all phrases of up to ``max_words`` words that do, as
    lists of word keys, single words included.

    A text without a language counts under ``und``; null texts are empty. Words are told apart by
    64 bits of hash, per language.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    with batches_of_bytes(docs.sparkSession, 4 * 2**20):
        shards = durable(rows.mapInArrow(_shards(shard_bytes), SHARD_SCHEMA))
    totals = shards.groupBy("lang").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n")
    )
    counted = (
        shards.select("lang", F.explode(F.arrays_zip("words", "keys", "counts")).alias("w"))
        .groupBy("lang", F.col("w.words").alias("word"))
        .agg(F.first("w.keys").alias("key"), F.sum("w.counts").alias("a"))
        .filter(F.col("a") >= min_count)
    )
    words = durable(counted)
    grams = words.select("lang", F.col("key").alias("w1"), "a")
    known = [grams]
    filters = [_filter(grams, 1)]
    with batches_of_bytes(docs.sparkSession, rows=1):
        for length in range(2, max_words + 1):
            names = _names(length)
            found = shards.select("lang", "keys", "ids").mapInArrow(
                _longer(filters), f"lang string, {', '.join(f'{c} long' for c in names)}, n long"
            )
            grams = found.groupBy("lang", *names).agg(F.sum("n").alias("a")).filter(F.col("a") >= min_count)
            grams = durable(grams)
            known.append(grams)
            if length < max_words:
                filters.append(_filter(grams, length))
    lists = [g.select("lang", F.array(*_names(i)).alias("words"), "a") for i, g in enumerate(known, 1)]
    phrases = lists[0]
    for more in lists[1:]:
        phrases = phrases.unionByName(more)
    return durable(totals), words, phrases


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The phrases of 2 to ``max_words`` words whose parts attract each other most, per language.

    Returns lang, rank (from 1), phrase, a, l, r, n, score: a phrase that occurs a times is cut into
    two parts that occur l and r times among n words, at the cut with the lowest
    floor(1000*a*n/(l*r)) (ties: the shorter first part). Phrases that occur nowhere but inside
    one longer phrase are left out. Order: score, then a, both falling, then phrase. Letters A-Z
    are lower-cased; pieces end at ``.,;:!?`` and line ends, words at blanks and tabs.

    Null texts are empty, a null language is ``und``. Repeated rows count as often as they stand; an
    empty table, or one without a frequent phrase, gives no rows; other columns are ignored.
    """
    totals, words, phrases = frequent_phrases(docs, min_count, max_words, shard_bytes)
    candidates = phrases.filter(F.size("words") > 1)
    longer = candidates.filter(F.size("words") > 2)
    last = F.size("words") - 1
    parts = longer.select(
        F.explode(F.array(F.slice("words", F.lit(1), last), F.slice("words", F.lit(2), last))).alias("words"), "a"
    )
    # A phrase within a longer one also stands within one that is a single word longer, and that
    # one lies between the two in frequency.
    longest = parts.groupBy("words").agg(F.max("a").alias("around"))
    kept = candidates.join(longest, "words", "left").filter(F.col("around").isNull() | (F.col("around") < F.col("a")))
    cuts = kept.select(
        "lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    ).withColumns(
        {
            "left": F.slice("words", F.lit(1), F.col("k")),
            "right": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")),
        }
    )
    left = phrases.select(F.col("words").alias("left"), F.col("a").alias("l"))
    right = phrases.select(F.col("words").alias("right"), F.col("a").alias("r"))
    score = F.expr(
        "(cast(1000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0)))"
        " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    )
    scored = cuts.join(left, "left").join(right, "right").join(totals, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "words", "a", "n", "cut.score", "cut.l", "cut.r")
    order = [F.desc("score"), F.desc("a")]
    near = Window.partitionBy("lang").orderBy(*order)
    # All that tie with the last one stay until their words are known.
    first = durable(best.withColumn("rank", F.rank().over(near)).filter(F.col("rank") <= top).drop("rank"))
    spelt = (
        first.select("lang", "words", F.posexplode("words").alias("at", "key"))
        .join(words.select("key", "word"), "key")
        .groupBy("lang", "words")
        .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"))
        .select("lang", "words", F.concat_ws(" ", F.col("spelt.word")).alias("phrase"))
    )
    final = Window.partitionBy("lang").orderBy(*order, "phrase")
    return (
        first.join(spelt, ["lang", "words"])
        .withColumn("rank", F.row_number().over(final).cast("long"))
        .filter(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
