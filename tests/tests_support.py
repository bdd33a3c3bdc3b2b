"""Helpers of the streaming tests."""

from __future__ import annotations

import time

from shelfmark.session import work_dir


def stream_of(spark, parts, schema=None, path=None):
    """A file stream whose batches are the given parts, one after the other."""
    path = path or work_dir(spark, "in")
    for part in parts:
        df = part if hasattr(part, "schema") else spark.createDataFrame(part, schema)
        df.coalesce(1).write.mode("append").parquet(path)
        # The source orders files by their modification time.
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def greedy(rows, ttl):
    """Event ids that are accepted when rows (key, at, event) arrive in time order."""
    last, kept = {}, []
    for at, event, key in sorted((at, e, k) for k, at, e in rows):
        if key not in last or at - last[key] > ttl:
            last[key] = at
            kept.append(event)
    return kept
