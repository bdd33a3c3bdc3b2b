"""Schemas and fixed settings."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import types as T

# Composite id of an entry, in comparison order.
ID = ["epoch_id", "leader_id", "entry_id"]
# A leader unit: the container of consecutive entry ids.
UNIT = ["epoch_id", "leader_id"]
# A shard: one partition of one category.
SHARD = ["category", "shard_id"]

# The defaults the catalog service publishes. The limits on hits (25 a shard, 1000
# merged, 500 united) are no defaults here: a search is complete unless its caller sets a limit.
PAGE_SIZE = 10
QUERY_TIMEOUT_SECONDS = 10
HIT_LIST_SECONDS = 25
REQUEST_TTL_SECONDS = 300
SPLIT_THRESHOLD = 10_000
MAX_DEPTH = 15
CONTAINER_SIZE = 1_000
PULL_BATCH = 25
UNITS_PER_PULL = 10
SEARCH_FANOUT = 3
ROUTING_ENTRIES = 20
TELEMETRY_WINDOW = "5 seconds"
WINDOWS_PER_DUMP = 50
CATEGORIES = ("Video", "Music", "Books", "Default")
LANDING_ENTRY_ID = -1

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("epoch_id", T.LongType()),
        T.StructField("leader_id", T.IntegerType()),
        T.StructField("entry_id", T.LongType()),
        T.StructField("global_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("uploaded", T.TimestampType()),
        T.StructField("language", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("leader_key", T.StringType()),
    ]
)

STATE_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("node_id", T.LongType()),
        T.StructField("partition_id", T.LongType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("leader_id", T.LongType()),
        T.StructField("is_leader", T.BooleanType()),
        T.StructField("num_entries", T.LongType()),
    ]
)

PATTERN_SCHEMA = T.StructType(
    [
        T.StructField("pattern_id", T.IntegerType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("min_size", T.LongType()),
        T.StructField("max_size", T.LongType()),
        T.StructField("min_ts", T.TimestampType()),
        T.StructField("max_ts", T.TimestampType()),
        T.StructField("language", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("page_from", T.IntegerType()),
        T.StructField("page_size", T.IntegerType()),
    ]
)


# What separates the tokens of a pattern, for one pattern and for a table of them.
TOKEN_BREAK = r"[ \t\n\r\f]+"


def split_tokens(text: str | None, fold_case: bool) -> list[str]:
    """Tokens of a clause, as the token column of a pattern table holds them."""
    folded = (text or "").lower() if fold_case else text or ""
    return [t for t in re.split(TOKEN_BREAK, folded) if t]


@dataclass(frozen=True)
class Pattern:
    """One search request. Every clause is optional."""

    file_name: str | None = None
    min_size: int = 0
    max_size: int = 0
    min_ts: datetime | None = None
    max_ts: datetime | None = None
    language: str | None = None
    category: str | None = None
    description: str | None = None

    def file_tokens(self) -> list[str]:
        return split_tokens(self.file_name, fold_case=True)

    def description_tokens(self, fold_case: bool = False) -> list[str]:
        return split_tokens(self.description, fold_case)
