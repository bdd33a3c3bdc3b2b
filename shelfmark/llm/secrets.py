"""Secrets in texts: patterns, and strings that zstandard cannot foresee in a sensitive context.

A candidate is a run of key characters shortly behind a word such as ``token`` or ``credential``.
Its novelty is what it adds to the compressed size of the code around it, when the compressor
has already read that code and a dictionary of identifiers: the words that stand in the sensitive
contexts of most documents of the whole corpus. Names, paths, placeholders and prose add little;
a key drawn at random adds about as many bytes as it has information.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.work import batches_of_bytes, durable

# Kinds of the base spans, in order, then that of the method.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
# Words that make what follows sensitive.
_SENSITIVE = re.compile(
    r"pass(?:word|wd|phrase|code)|pwd|secret|token|credential|bearer|authorization|api[_-]?key|"
    r"(?:access|private|signing|encryption|client|master|session)[_-]?(?:key|id)",
    re.I | re.A,
)
# How these words begin: texts without any of them are not searched.
_HINTS = (
    "pass", "pwd", "secret", "token", "credential", "bearer", "authorization", "api",
    "access", "private", "signing", "encryption", "client", "master", "session",
)

REACH = 64
MIN_CHARS = 16
CONTEXT = 256
#: A reported string costs so many bytes for each of its characters, and these more, which any
#: string costs that stands in the way.
BYTES_A_CHARACTER = 0.75
BYTES_OF_ANY = 2
DICTIONARY_WORDS = 4096
DICTIONARY_BYTES = 32 * 2**10
LEVEL = 19
MIN_MATCH = 3
_RUN = re.compile(r"[A-Za-z0-9+/_.-]{16,}={0,2}")
_WORD = re.compile(r"[A-Za-z]{3,}")

SPAN = "array<struct<kind:string,start:long,end:long>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
FOUND_SCHEMA = f"doc_id long, base {SPAN}, runs array<struct<start:long,end:long>>, text string"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

Span = tuple[int, int]


def base_spans(text: str) -> dict[str, list[Span]]:
    """Matches of the patterns, leftmost and without overlap per kind."""
    found: dict[str, list[Span]] = {"assign": [], "access": [], "hex": []}
    low = text.lower()
    if any(word in low for word in ("pass", "secret", "token", "api")):
        found["assign"] = [m.span() for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found["access"] = [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # A run of 32 or more from its first character is the whole run.
    found["hex"] = [m.span() for m in _HEX.finditer(text)]
    return found


def _mixed(run: str) -> bool:
    """Whether a run has letters of two kinds, or letters and digits; a capital in front is none."""
    body = run[1:]
    kinds = (
        any("a" <= c <= "z" for c in run),
        any("A" <= c <= "Z" for c in body),
        any("0" <= c <= "9" for c in run),
    )
    return sum(kinds) > 1


def sensitive_runs(text: str, base: dict[str, list[Span]]) -> list[Span]:
    """Runs of key characters that begin at most ``REACH`` characters behind a sensitive word, or
    hold one, and lie in no base span."""
    low = text.lower()
    if not any(hint in low for hint in _HINTS):
        return []
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    if not words:
        return []
    starts = [w[0] for w in words]
    taken = sorted(span for spans in base.values() for span in spans)
    ends, last = [], 0
    for _, end in taken:
        last = max(last, end)
        ends.append(last)
    taken_starts = [s for s, _ in taken]
    found = []
    for m in _RUN.finditer(text):
        start, end = m.span()
        while end > start and text[end - 1] in ".-_/":
            end -= 1
        while start < end and text[start] in ".-_/":
            start += 1
        if end - start < MIN_CHARS:
            continue
        near = bisect_left(starts, end)
        if near == 0 or words[near - 1][1] < start - REACH:
            continue
        over = bisect_left(taken_starts, end)
        if over and ends[over - 1] > start:
            continue
        if _mixed(text[start:end]):
            found.append((start, end))
    return found


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_base, all_runs, texts = [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = base_spans(text)
            runs = sensitive_runs(text, base)
            spans = [(s, k, e) for k, kind in enumerate(KINDS[:3]) for s, e in base[kind]]
            all_base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(spans)])
            all_runs.append([{"start": s, "end": e} for s, e in runs])
            texts.append(text if runs else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(all_base, SPAN_TYPE), pa.array(all_runs, RUN_TYPE), pa.array(texts, pa.string())],
            names=["doc_id", "base", "runs", "text"],
        )


def _windows(spans: list[Span], size: int) -> list[Span]:
    """The spans with ``size`` characters around them, those that touch joined."""
    found: list[Span] = []
    for start, end in spans:
        start, end = max(0, start - size), end + size
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], end))
        else:
            found.append((start, end))
    return found


def _identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents each word stands near a candidate or in it."""
    for batch in batches:
        counts: Counter[str] = Counter()
        for runs, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = value.as_py()
            words = set()
            for start, end in _windows([(r["start"], r["end"]) for r in runs], CONTEXT):
                words.update(_WORD.findall(text[start:end]))
            counts.update(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )


def identifier_dictionary(found: DataFrame, words: int = DICTIONARY_WORDS, size: int = DICTIONARY_BYTES) -> bytes:
    """The words of most sensitive contexts, the most frequent last, where zstandard finds them at
    the least distance. Words of one document only are left out; at most ``words`` reach the driver.
    """
    counted = found.filter(F.col("text").isNotNull()).select("runs", "text").mapInArrow(_identifiers, "word string, n long")
    totals = counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") > 1)
    top = [r["word"] for r in totals.orderBy(F.desc("n"), "word").limit(words).collect()]
    held, length = [], 0
    for word in top:
        length += len(word) + 1
        if length > size:
            break
        held.append(word)
    return " ".join(reversed(held)).encode()


class Novelty:
    """Marginal compressed sizes under one dictionary."""

    def __init__(self, dictionary: bytes):
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=MIN_MATCH, write_content_size=False, write_dict_id=False, write_checksum=False
        )
        held = None
        if len(dictionary) >= 8:
            held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=parameters)
        self._compressor = zstandard.ZstdCompressor(compression_params=parameters, dict_data=held)

    def _size(self, text: str) -> int:
        return len(self._compressor.compress(text.encode("utf-8", "replace")))

    def bytes_of(self, text: str, start: int, end: int) -> int:
        """What text[start:end] adds to the compressed size of the text around it, in its place,
        in front or behind: the least of the three, as single sizes depend on how blocks are cut."""
        before, run, after = text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]
        placed = (before + run + after, run + " " + before + after, before + after + " " + run)
        return min(map(self._size, placed)) - self._size(before + after)

    def is_novel(self, text: str, start: int, end: int) -> bool:
        return self.bytes_of(text, start, end) >= BYTES_OF_ANY + BYTES_A_CHARACTER * (end - start)


def _judge(dictionary: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary.value)
        order = {kind: i for i, kind in enumerate(KINDS)}
        for batch in batches:
            spans = []
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True)
            for base, runs, value in rows:
                if runs:
                    text = value.as_py()
                    base = base + [
                        {"kind": "novel", **r} for r in runs if novelty.is_novel(text, r["start"], r["end"])
                    ]
                    base.sort(key=lambda s: (s["start"], order[s["kind"]]))
                spans.append(base)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, SPAN_TYPE)], names=["doc_id", "base", "spans"]
            )

    return judge


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` of every row: lists of (kind, start, end) in code points,
    end exclusive, ordered by start, then by kind as in ``KINDS``.

    ``base`` holds the matches of the patterns: assignments to names such as ``password`` with a value
    of 8 or more characters, access keys of 16 or more, lower-case hexadecimal runs of 32 or
    more. ``spans`` holds these and the strings of kind ``novel``: runs of 16 or more key characters
    of two kinds (small, capital, digit), outside base spans, that hold a sensitive word or
    begin within 64 characters behind one, and whose marginal compressed size is at least 2 bytes
    and 0.75 bytes a character, given 256 characters on either side and the dictionary of
    identifiers of the whole table.

    Null texts are empty. Each row is judged by itself, so repeated rows and null ids give a row
    each; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with batches_of_bytes(docs.sparkSession):
        found = durable(rows.mapInArrow(_find, FOUND_SCHEMA))
        dictionary = docs.sparkSession.sparkContext.broadcast(identifier_dictionary(found))
        return durable(found.mapInArrow(_judge(dictionary), f"doc_id long, base {SPAN}, spans {SPAN}"))
