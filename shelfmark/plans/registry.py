"""What a registered query is, and the collection of all of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    """A query over the given tables; ``sql`` is its check, if it has one."""

    run: Run
    sql: str | None = None


def all_queries() -> dict[str, Query]:
    from shelfmark.plans import (
        catalog_queries,
        peer_queries,
        search_queries,
        streaming_queries,
        telemetry_queries,
        unit_queries,
    )

    found: dict[str, Query] = {}
    for module in (
        catalog_queries,
        search_queries,
        unit_queries,
        peer_queries,
        telemetry_queries,
        streaming_queries,
    ):
        overlap = found.keys() & module.QUERIES.keys()
        if overlap:
            raise ValueError(f"registered twice: {sorted(overlap)}")
        found.update(module.QUERIES)
    return found
