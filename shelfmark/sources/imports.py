"""Catalog entries from XML dumps and from web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TORRENT_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("magnet", T.StringType()),
        T.StructField("_malformed", T.StringType()),
    ]
)
END_TAG = "</torrent>"
TITLE = r"<title>([^<]*)</title>"


def _with_defaults(df: DataFrame, category: str) -> DataFrame:
    fixed: dict[str, Column] = {
        "global_id": F.lit(""),
        "file_size": F.lit(0).cast("bigint"),
        "uploaded": F.lit(None).cast("timestamp"),
        "language": F.lit(""),
        "category": F.lit(category),
        "description": F.lit(""),
        "hash": F.lit(""),
        "leader_key": F.lit(""),
    }
    return df.withColumns({k: v for k, v in fixed.items() if k not in df.columns})


def read_torrents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records of a dump as entries, and the malformed records apart.

    A record ends with ``</torrent>``; a dump needs no root element. The end tag is
    the line separator of the text source, so large files are still split.
    """
    pieces = spark.read.option("lineSep", END_TAG).text(path)
    record = F.concat(F.regexp_extract("value", r"(?s)<torrent[\s>].*", 0), F.lit(END_TAG))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}
    raw = pieces.filter(F.col("value").contains("<torrent")).select(
        F.from_xml(record, TORRENT_SCHEMA, options).alias("r")
    )
    raw = raw.select("r.*")
    bad = F.col("_malformed").isNotNull()
    good = raw.filter(~bad).select(
        F.coalesce("title", F.lit("")).alias("file_name"),
        F.coalesce("magnet", F.lit("")).alias("url"),
    )
    return _with_defaults(good, "Books"), raw.filter(bad).select("_malformed")


def pages_to_entries(pages: DataFrame) -> DataFrame:
    """The title of a page becomes the file name, its address the url."""
    found = pages.select(
        F.col("page_id").alias("id"),
        "url",
        F.regexp_extract("html", TITLE, 1).alias("file_name"),
    )
    return _with_defaults(found, "Books")
