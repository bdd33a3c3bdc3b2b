"""Packing of tokenised documents into sequences: first-fit decreasing over a tournament tree."""

from __future__ import annotations

import sys
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.words import mix
from shelfmark.llm.work import small_batches

SEQUENCE = 2048
GROUP_DOCUMENTS = 4096

PIECES_SCHEMA = "group_id long, doc_id long, start long, ids binary, doc_tokens long"
PACKED_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, for a byte-level BPE file.

    Texts that hold an added token's string go through ``tokenizers`` itself; the others
    through tiktoken with the vocabulary of the same file, which gives the same ids (a test
    compares them) at about four times the speed.
    """

    def __init__(self, path: str, end_id: int):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in own}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters.values())}
        ranks = {
            bytes(letters[c] for c in word): rank
            for word, rank in self.tokenizer.get_vocab(with_added_tokens=False).items()
            if all(c in letters for c in word) and word not in self.special
        }
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = np.array([end_id], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        found = array("I", ids)
        if sys.byteorder != "little":
            found.byteswap()
        return found.tobytes() + self.end


def _pieces(path: str, end_id: int, groups: int, sequence: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, end_id)
        # How many rows of the same id and text the task has met: equal rows go to different groups,
        # and the order in which rows reach the task decides nothing.
        met: Counter[int] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(0).to_pylist()
                texts = part.column(1).fill_null("").to_pylist()
                task = part.column(2)[0].as_py()
                keys = part.column(3).to_pylist()
                out: list[tuple] = []
                for doc_id, text, key in zip(ids, texts, keys, strict=True):
                    tokens = encoder.encode(text)
                    total = len(tokens) // 4
                    for start in range(0, total, sequence):
                        place = task << 44 ^ met[key] << 16 ^ start // sequence
                        out.append((place, doc_id, start, tokens[4 * start : 4 * (start + sequence)], total, key))
                    met[key] += 1
                mixed = mix(np.array([x[0] % 2**64 for x in out], np.uint64))
                mixed = mix(mixed ^ np.array([x[5] for x in out], np.int64).view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((mixed % np.uint64(groups)).astype(np.int64)),
                        pa.array([x[1] for x in out], pa.int64()),
                        pa.array([x[2] for x in out], pa.int64()),
                        pa.array([x[3] for x in out], pa.binary()),
                        pa.array([x[4] for x in out], pa.int64()),
                    ],
                    names=["group_id", "doc_id", "start", "ids", "doc_tokens"],
                )

    return cut


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Longer pieces first; each goes to the first bin with room.

    The room of all bins stands in the leaves of a tournament tree whose inner nodes hold the
    most room below them, so the first bin is found by one walk from the root.
    """
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in order:
        need = sizes[i]
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i] = node - leaves
        offsets[i] = capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def _pack_group(sequence: int) -> Callable[[pa.Table], pa.Table]:
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        lengths = np.array([len(x) // 4 for x in table["ids"].to_pylist()], np.int64)
        bins, offsets = first_fit_decreasing(lengths, sequence)
        group = table["group_id"].to_numpy()
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "start": table["start"],
                "length": pa.array(lengths),
                "ids": table["ids"],
                "doc_tokens": table["doc_tokens"],
                "sequence_id": pa.array((group << 32) + bins),
                "offset": pa.array(offsets),
            }
        )

    return pack


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    sequence: int = SEQUENCE,
    end_id: int = 1,
    group_documents: int = GROUP_DOCUMENTS,
) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and pack their ids into sequences of ``sequence`` ids.

    A document is its text's ids and ``end_id``; a null text is empty and has that id alone.
    It is cut every ``sequence`` ids, and the pieces of a group are packed first-fit decreasing.
    Groups take pieces by a hash of their id, text and place, about ``group_documents`` documents
    each, so neither a long document nor a repeated row fills one, and a task that is run again
    deals its pieces as before, in whichever order rows reach it. Returns a row for each piece with its
    ids (little-endian, 32 bits), its document's number of ids, its sequence and its offset
    there; sequences have no gaps. Rows that share a doc_id are separate documents with equal
    names; a null doc_id stays null. An empty table gives no rows; other columns are ignored.

    ``tokenizer_path`` names a byte-level BPE file that every executor can read.
    """
    small_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_documents))
    doc_id = F.col("doc_id").cast("long")
    key = F.xxhash64(doc_id, F.coalesce("text", F.lit("")))
    named = docs.select(doc_id.alias("doc_id"), "text", F.spark_partition_id().alias("task"), key.alias("key"))
    pieces = named.mapInArrow(_pieces(tokenizer_path, end_id, groups, sequence), PIECES_SCHEMA)
    return pieces.groupBy("group_id").applyInArrow(_pack_group(sequence), PACKED_SCHEMA)
