"""Row digests over the descriptive fields of an entry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u0001"


def entry_digest(id_column: str = "entry_id") -> Column:
    """Hex SHA-1 over id, size, upload millis, category, url, file name, language, description."""
    millis = F.unix_millis(F.col("uploaded"))
    fields = [
        F.col(id_column).cast("string"),
        F.col("file_size").cast("string"),
        millis.cast("string"),
        F.col("category"),
        F.col("url"),
        F.col("file_name"),
        F.col("language"),
        F.col("description"),
    ]
    return F.sha1(F.concat_ws(SEPARATOR, *(F.coalesce(f, F.lit("")) for f in fields)))
