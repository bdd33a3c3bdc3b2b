"""All queries of this subpackage."""

from __future__ import annotations

from shelfmark.llm import (
    chat_queries,
    collocation_queries,
    contamination_queries,
    embedding_queries,
    language_queries,
    near_copy_queries,
    license_queries,
    packing_queries,
    personal_data_queries,
    quality_queries,
    repeat_queries,
    secret_queries,
    whitening_queries,
)
from shelfmark.plans.registry import Query

MODULES = (
    language_queries,
    near_copy_queries,
    contamination_queries,
    embedding_queries,
    chat_queries,
    packing_queries,
    personal_data_queries,
    quality_queries,
    repeat_queries,
    license_queries,
    collocation_queries,
    secret_queries,
    whitening_queries,
)


def llm_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found
