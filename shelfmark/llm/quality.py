"""Quality by weak labels: overlapping heuristic labellers, expectation-maximisation for their
accuracies, and a hashed linear scorer trained on the posterior labels.

1. Every document gets a vote (good, bad, none) from each labeller; votes are counted by pattern.
2. EM over the pattern counts estimates the share of good documents and, for each labeller, how
   often it votes what on good and on bad ones. Labellers are taken as independent given the class.
3. A linear scorer over hashed words and word shapes learns the posteriors of a bounded sample of
   documents, by gradient steps that each are one pass over that sample.
4. All documents are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.words import U64, Words, mix, occurrences, word_slices
from shelfmark.llm.work import durable

BAD, GOOD, NONE = 0, 1, 2
TRAIN_DOCUMENTS = 20_000
STEPS = 30
RATE = 0.5
WORD_BITS = 14
SHAPE_BITS = 12
FEATURES = 2**WORD_BITS + 2 * 2**SHAPE_BITS
SCORE_SCHEMA = "doc_id long, posterior double, score double, keep boolean"

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and to in is it that was for on are with as be at this by from or an "
    "le la les de des du et un une dans est que qui pour sur "
    "der die das und ist von zu den mit nicht ein eine auf sich im "
    "el los las y en del por con no una para su al"
).split()

# Labellers: a measure of the text, and what speaks for a bad and for a good one.
LABELLERS: tuple[tuple[str, Callable, Callable], ...] = (
    ("symbols", lambda m: m["symbols"] > 0.15, lambda m: m["symbols"] < 0.06),
    ("capitals", lambda m: m["capitals"] > 0.5, lambda m: m["capitals"] < 0.2),
    ("word_length", lambda m: (m["length"] < 2.5) | (m["length"] > 14), lambda m: (m["length"] > 3) & (m["length"] < 10)),
    ("variety", lambda m: (m["variety"] < 0.2) & (m["words"] >= 20), lambda m: (m["variety"] > 0.5) & (m["words"] >= 20)),
    ("function_words", lambda m: (m["function"] < 0.01) & (m["words"] >= 20), lambda m: m["function"] > 0.05),
    ("symbol_tails", lambda m: m["tails"] > 0.3, lambda m: m["tails"] < 0.05),
    ("lone_symbols", lambda m: m["lone"] > 0.1, lambda m: m["lone"] < 0.01),
    ("lines", lambda m: m["repeated"] > 0.3, lambda m: (m["repeated"] < 0.1) & (m["lines"] >= 2)),
    ("runs", lambda m: m["runs"] > 0.2, lambda m: m["runs"] < 0.02),
)
PATTERNS = 3 ** len(LABELLERS)

_CLASS = np.full(256, 4, np.uint8)  # 0 upper, 1 other letter, 2 digit, 3 blank, 4 symbol, 5 sentence mark
_CLASS[65:91] = 0
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[48:58] = 2
_CLASS[[0x20, *range(9, 14)]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5


def _per_row(values: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=rows)


def _function_hashes() -> np.ndarray:
    forms = sorted({f for w in FUNCTION_WORDS for f in (w, w.capitalize(), w.upper())})
    return np.sort(next(word_slices(pa.array([" ".join(forms)]))).hashes)


_FUNCTION = _function_hashes()


def measures(words: Words, rows_of_bytes: np.ndarray, lines: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """What the labellers look at, per row; shares of nothing are 0."""
    n = words.rows
    kind = _CLASS[words.data]

    def of_kind(*kinds: int) -> np.ndarray:
        return np.bincount(rows_of_bytes[np.isin(kind, kinds)], minlength=n).astype(float)

    upper, symbols = of_kind(0), of_kind(4)
    letters = upper + of_kind(1)
    solid = np.maximum(1, letters + symbols + of_kind(2, 5))
    count = words.counts().astype(float)
    some = np.maximum(1, count)
    at = np.searchsorted(_FUNCTION, words.hashes)
    function = _FUNCTION[np.minimum(at, len(_FUNCTION) - 1)] == words.hashes
    fresh = occurrences(mix(words.hashes ^ mix(words.doc.astype(U64) + U64(7)))) == 0
    symbol = np.concatenate([[0], np.cumsum(kind == 4)])
    marks = np.concatenate([[0], np.cumsum((kind == 4) | (kind == 5))])
    size = words.end - words.start
    lone = marks[words.end] - marks[words.start] == size
    tail = (symbol[words.end] - symbol[words.end - 1]) > 0
    return {
        "words": count,
        "symbols": symbols / solid,
        "capitals": upper / np.maximum(1, letters),
        "length": _per_row(size, words.doc, n) / some,
        "variety": _per_row(fresh, words.doc, n) / some,
        "function": _per_row(function, words.doc, n) / some,
        "tails": _per_row(tail, words.doc, n) / some,
        "lone": _per_row(lone, words.doc, n) / some,
        "runs": _per_row(_again(words), words.doc, n) / some,
        "lines": lines[0],
        "repeated": lines[1] / np.maximum(1, lines[0]),
    }


def _lines(words: Words, rows_of_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-empty lines of each row, and how many of them stand there again."""
    breaks = np.concatenate([[0], np.cumsum(words.data == 10)])
    line = breaks[words.start] + words.doc
    if not len(line):
        return np.zeros(words.rows), np.zeros(words.rows)
    begin = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (words.doc[1:] != words.doc[:-1])])
    doc = words.doc[begin]
    place = np.arange(len(line)) - begin[np.searchsorted(begin, np.arange(len(line)), side="right") - 1]
    key = mix(np.add.reduceat(mix(words.hashes + place.astype(U64)), begin) ^ mix(doc.astype(U64)))
    again = occurrences(key) > 0
    return np.bincount(doc, minlength=words.rows).astype(float), np.bincount(doc[again], minlength=words.rows).astype(float)


def _again(words: Words) -> np.ndarray:
    """Which words are the same as the one before them in the text."""
    same = np.zeros(len(words.doc), dtype=bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    return same


def _rows_of_bytes(words: Words, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(words.rows), sizes)


def votes(measured: dict[str, np.ndarray]) -> np.ndarray:
    """The pattern of each row: its labellers' votes as digits to base 3."""
    code = np.zeros(len(measured["words"]), np.int64)
    for _, bad, good in LABELLERS:
        vote = np.where(bad(measured), BAD, np.where(good(measured), GOOD, NONE))
        code = code * 3 + vote
    return code


def vote_matrix(codes: np.ndarray) -> np.ndarray:
    """Rows of votes from patterns."""
    powers = 3 ** np.arange(len(LABELLERS) - 1, -1, -1)
    return codes[:, None] // powers % 3


def features(words: Words) -> np.ndarray:
    """Three hashed features of each word: itself, its shape, and its shape with the next one's."""
    kind = _CLASS[words.data]
    shape = np.zeros(len(words.doc), np.int64)
    for bit, kinds in enumerate(((0,), (1,), (2,), (4,), (5,))):
        total = np.concatenate([[0], np.cumsum(np.isin(kind, kinds))])
        shape |= (total[words.end] > total[words.start]).astype(np.int64) << bit
    last = kind[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    length = np.minimum(words.end - words.start, 15)
    repeats = np.minimum(np.log2(1 + occurrences(mix(words.hashes ^ mix(words.doc.astype(U64))))).astype(np.int64), 7)
    whole = ((((shape << 3 | last) << 4 | length) << 3 | repeats) << 1 | _again(words)).astype(U64)
    following = np.zeros_like(whole)
    following[:-1] = np.where(words.doc[1:] == words.doc[:-1], whole[1:], U64(0))
    pair = mix(mix(whole) * U64(31) + mix(following))
    top = U64(64 - SHAPE_BITS)
    return np.stack(
        [
            (words.hashes >> U64(64 - WORD_BITS)).astype(np.int64),
            2**WORD_BITS + (mix(whole) >> top).astype(np.int64),
            2**WORD_BITS + 2**SHAPE_BITS + (pair >> top).astype(np.int64),
        ],
        axis=1,
    )


def _slices(texts: pa.Array) -> Iterator[tuple[Words, np.ndarray]]:
    """Words and patterns of votes, slice by slice."""
    sizes = np.diff(np.frombuffer(texts.cast(pa.large_string()).fill_null("").buffers()[1], np.int64)) if len(texts) else []
    for words in word_slices(texts):
        owner = _rows_of_bytes(words, sizes[words.first_row : words.first_row + words.rows])
        yield words, votes(measures(words, owner, _lines(words, owner)))


def _count_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(PATTERNS, np.int64)
    for batch in batches:
        for _, codes in _slices(batch.column(0)):
            counts += np.bincount(codes, minlength=PATTERNS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["code", "n"])


@dataclass
class LabelModel:
    """Share of good documents, and the probability of each vote by labeller and class, given
    that the labeller votes; no vote says nothing."""

    good: float
    chances: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        matrix = vote_matrix(codes)
        told = np.log(np.array([1 - self.good, self.good]))[None, :].repeat(len(codes), axis=0)
        for i in range(matrix.shape[1]):
            told += np.log(self.chances[i][:, matrix[:, i]]).T
        return 1 / (1 + np.exp(np.clip(told[:, BAD] - told[:, GOOD], -500, 500)))


def estimate(codes: np.ndarray, n: np.ndarray, rounds: int = 100) -> LabelModel:
    """EM over patterns and their counts, from the majority of votes on."""
    matrix = vote_matrix(codes)
    ayes, noes = (matrix == GOOD).sum(axis=1), (matrix == BAD).sum(axis=1)
    belief = (ayes + 1) / (ayes + noes + 2)
    model = LabelModel(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([(1 - belief) * n, belief * n])
        whole = weight.sum(axis=1)
        chances = np.stack(
            [
                np.stack([np.bincount(matrix[:, i], weights=w, minlength=3) for w in weight]) + 1
                for i in range(len(LABELLERS))
            ]
        )
        chances = chances / chances[:, :, :NONE].sum(axis=2, keepdims=True)
        chances[:, :, NONE] = 1
        model = LabelModel((whole[GOOD] + 1) / (whole.sum() + 2), chances)
        new = model.posterior(codes)
        if np.abs(new - belief).max(initial=0) < 1e-9:
            break
        belief = new
    return model


def _sample(model: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sparse features and posterior of documents that have words."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, codes in _slices(batch.column(0)):
                belief = model.value.posterior(codes)
                used = features(words)
                offsets = words.offsets()
                out = []
                for row in np.flatnonzero(np.diff(offsets)):
                    at, count = np.unique(used[offsets[row] : offsets[row + 1]], return_counts=True)
                    share = count / (offsets[row + 1] - offsets[row])
                    out.append((belief[row], at.astype(np.int32).tobytes(), share.astype(np.float32).tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.float64(), pa.binary(), pa.binary()))],
                    names=["belief", "at", "share"],
                )

    return sample


def _gradient(weights: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for the whole task: the sum of its documents' gradients and their weight."""

    def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        total = np.zeros(FEATURES + 2)
        for batch in batches:
            beliefs = batch.column(0).to_numpy()
            for belief, at, share in zip(beliefs, batch.column(1), batch.column(2), strict=True):
                place = np.frombuffer(at.as_py(), np.int32)
                x = np.frombuffer(share.as_py(), np.float32)
                sure = abs(2 * belief - 1)
                error = sure * (1 / (1 + np.exp(-np.clip(w[place] @ x + w[FEATURES], -30, 30))) - belief)
                total[place] += error * x
                total[FEATURES] += error
                total[FEATURES + 1] += sure
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return gradient


def fit(sample: DataFrame, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """Weights and bias by gradient steps, each scaled by the root of the squares so far. The
    sample is bounded, and so is what a step brings to the driver: a vector for each of its tasks."""
    spark = sample.sparkSession
    weights, squares = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-12)
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(weights)
        parts = sample.mapInArrow(_gradient(shared), "total binary").toArrow()["total"].to_pylist()
        total = np.sum([np.frombuffer(p) for p in parts], axis=0) if parts else np.zeros(FEATURES + 2)
        slope = total[:-1] / max(total[-1], 1e-9)
        squares += slope**2
        weights = weights - rate * slope / np.sqrt(squares)
        shared.destroy()
    return weights


def _score(model: Broadcast, weights: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for words, codes in _slices(batch.column(1)):
                count = words.counts()
                told = w[features(words)].sum(axis=1)
                linear = np.bincount(words.doc, weights=told, minlength=words.rows) / np.maximum(1, count) + w[FEATURES]
                value = np.where(count > 0, 1 / (1 + np.exp(-np.clip(linear, -500, 500))), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.first_row, words.rows),
                        pa.array(model.value.posterior(codes)),
                        pa.array(value),
                        pa.array(value >= 0.5),
                    ],
                    names=["doc_id", "posterior", "score", "keep"],
                )

    return score


def quality(docs: DataFrame, train_documents: int = TRAIN_DOCUMENTS, steps: int = STEPS) -> DataFrame:
    """``doc_id``, ``posterior`` (of the label model), ``score`` (of the scorer, 0 to 1) and ``keep``
    (score at least one half) of every row.

    The votes of all documents go into the label model. The scorer learns from about
    ``train_documents`` of them, those with the least hashes of id and text. Null texts are
    empty; a text without words scores 0. Repeated rows give equal rows; a null doc_id stays
    null; an empty table gives no rows; other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    patterns = rows.select("text").mapInArrow(_count_patterns, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    label_model = estimate(patterns["code"].to_numpy().astype(np.int64), patterns["n"].to_numpy())
    shared = context.broadcast(label_model)
    keyed = rows.withColumn("hash", F.xxhash64("doc_id", "text"))
    last = keyed.select("hash").orderBy("hash").limit(train_documents).agg(F.max("hash")).first()[0]
    chosen = keyed.filter(F.col("hash") <= F.lit(last if last is not None else 0)).select("text")
    weights = fit(durable(chosen.mapInArrow(_sample(shared), "belief double, at binary, share binary")), steps)
    return rows.mapInArrow(_score(shared, context.broadcast(weights)), SCORE_SCHEMA)
