"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.work import small_batches

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
SMOOTHING = 0.5
MAX_LANGUAGES = 256
UNKNOWN = "und"
MIN_SCORE = 0.5
PIECE_CHARS = 2**18
COUNT_SCHEMA = "lang string, bucket int, n long"
PREDICTION_SCHEMA = "doc_id long, lang_pred string, score double"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of lower-cased texts and the row of each, a bounded number at a time.

    Whatever is not a letter is a blank; each run of blanks is one, and so are both ends.
    """
    letters = _letters()
    held: list[str] = []
    rows: list[int] = []
    chars = 0

    def codes() -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in held])
        raw = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.array(rows), sizes)
        raw = np.where(letters[raw], raw, 32)
        keep = np.ones(len(raw), dtype=bool)
        keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32) | (row[1:] != row[:-1])
        return raw[keep].astype(np.uint64), row[keep]

    for number, text in enumerate(texts):
        if not text:
            continue
        for at in range(0, len(text), PIECE_CHARS):
            piece = f" {text[at : at + PIECE_CHARS].lower()} "
            held.append(piece)
            rows.append(number)
            chars += len(piece)
            if chars >= PIECE_CHARS:
                yield codes()
                held, rows, chars = [], [], 0
    if held:
        yield codes()


def _buckets(codes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash bucket and row of every n-gram that holds a letter, order by order."""
    key = np.zeros(len(codes), np.uint64)
    blank = codes == 32
    for n in ORDERS:
        count = len(codes) - n + 1
        if count <= 0:
            return
        key = key[:count] * np.uint64(0x100000001B3) + codes[n - 1 :]
        inside = rows[:count] == rows[n - 1 :]
        if n == 1:
            inside &= ~blank
        mixed = (key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)[inside], rows[:count][inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 2**BUCKET_BITS
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            langs = part.column(0).to_pylist()
            names = sorted(set(langs))
            number = {lang: i for i, lang in enumerate(names)}
            of_row = np.array([number[lang] for lang in langs])
            for lang in names:
                counts.setdefault(lang, np.zeros(size + 1, np.int64))[size] += langs.count(lang)
            for codes, rows in _pieces(part.column(1).to_pylist()):
                for bucket, row in _buckets(codes, rows):
                    flat = np.bincount(of_row[row] * size + bucket, minlength=len(names) * size)
                    for i, lang in enumerate(names):
                        counts[lang][:size] += flat[i * size : (i + 1) * size]
    for lang, table in counts.items():
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(table[used])],
            names=["lang", "bucket", "n"],
        )


@dataclass
class LanguageModel:
    """Languages in order, log-probability of each bucket (rows) in each of them, log priors."""

    languages: list[str]
    weights: np.ndarray
    priors: np.ndarray


def train(labelled: DataFrame, max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Learn from all rows of ``labelled`` (lang, text); rows with a null lang are left out.

    The counts of a language are a row per hash bucket, so what reaches the driver is bounded
    by the number of languages, of which more than ``max_languages`` are refused.
    """
    small_batches(labelled.sparkSession)
    counted = (
        labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text"))
        .filter(F.col("lang").isNotNull())
        .mapInArrow(_count, COUNT_SCHEMA)
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    # A row more than that many languages can have, so that more of them show.
    table = counted.limit(max_languages * (2**BUCKET_BITS + 1) + 1).toArrow()
    if len(table["lang"].unique()) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn")
    return model_of(table["lang"].to_pylist(), table["bucket"].to_numpy(), table["n"].to_numpy())


def model_of(langs: list[str], buckets: np.ndarray, n: np.ndarray) -> LanguageModel:
    languages = sorted(set(langs))
    number = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((2**BUCKET_BITS + 1, len(languages)))
    counts[buckets, [number[lang] for lang in langs]] = n
    documents, counts = counts[-1], counts[:-1] + SMOOTHING
    weights = np.log(counts / counts.sum(axis=0)) if languages else counts
    priors = np.log(documents / documents.sum()) if languages else documents
    return LanguageModel(languages, weights, priors)


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The most probable language of each text and its posterior probability."""
    size = len(model.languages)
    total = np.tile(model.priors, (len(texts), 1))
    seen = np.zeros(len(texts), dtype=bool)
    if size:
        for codes, rows in _pieces(texts):
            for bucket, row in _buckets(codes, rows):
                if not len(row):
                    continue
                begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                total[row[begin]] += np.add.reduceat(model.weights[bucket], begin, axis=0)
                seen[row[begin]] = True
    if not size:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = total.argmax(axis=1)
    top = total.max(axis=1, keepdims=True)
    score = 1.0 / np.exp(total - top).sum(axis=1)
    names = [model.languages[i] if s else UNKNOWN for i, s in zip(best, seen, strict=True)]
    return names, np.where(seen, score, 0.0)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for at in range(0, batch.num_rows, 512):
        part = batch.slice(at, 512)
        yield part, part.column(column).to_pylist()


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (posterior, 0 to 1) of every row of docs.

    The text alone is read, whole. A text that is null or has no letter is ``und`` with score 0,
    and so is every text if there was nothing to learn from. Equal posteriors go to the first
    language by name. Each row is scored by itself, so repeated rows give equal rows; a null
    doc_id stays null; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch, 1):
                names, score = score_texts(shared.value, texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(score)],
                    names=["doc_id", "lang_pred", "score"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, PREDICTION_SCHEMA)


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, unchanged, whose language is known with at least ``min_score``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch, text_at):
                names, score = score_texts(shared.value, texts)
                keep = (score >= min_score) & np.array([n != UNKNOWN for n in names], dtype=bool)
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(sift, docs.schema)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3
