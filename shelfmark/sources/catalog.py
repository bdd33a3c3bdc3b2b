"""The catalog store: Parquet parts, partitioned by category, in versions (see ``generations``).

A version is a list of pieces, the category folders of the parts. Additions write a new part;
deletions write what stays of the pieces that lose rows as a new part and name that instead.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.predicates import MIN_LONG, any_of
from shelfmark.schema import ENTRY_SCHEMA, ID
from shelfmark.sources import generations
from shelfmark.sources.generations import DATA, Version

#: With more parts than this, ``compact_entries`` writes them as one.
MOST_PARTS = 8

# What a missing field reads as.
READ_DEFAULTS = {
    "global_id": "",
    "url": "",
    "file_name": "",
    "file_size": 0,
    "language": "",
    "category": "Default",
    "description": "",
    "hash": "",
    "leader_key": "",
}
ID_DEFAULT = MIN_LONG


def _filled(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *(
            F.coalesce(F.col(c), F.lit(defaults[c]).cast(types[c])).alias(c)
            if c in defaults
            else F.col(c)
            for c in df.columns
        )
    )


def fill_entries(df: DataFrame) -> DataFrame:
    """Replace missing fields by what a reader of the store sees."""
    return _filled(df, {**READ_DEFAULTS, "entry_id": ID_DEFAULT})


def _pieces(spark: SparkSession, path: str, held: Version) -> DataFrame:
    """All rows of a version, with the part that each stands in."""
    folders = [f"{path}/{DATA}/{p['folder']}/{piece}" for p in held.parts for piece in p["pieces"]]
    names = [f.name for f in ENTRY_SCHEMA.fields]
    if not folders:
        return spark.createDataFrame([], ENTRY_SCHEMA).withColumn("part", F.lit("")).select(*names, "part")
    reader = spark.read.schema(ENTRY_SCHEMA).option("basePath", f"{path}/{DATA}")
    return reader.parquet(*folders).select(*names, "part")


def read_entries(
    spark: SparkSession, path: str, complete: bool = False, number: int | None = None
) -> DataFrame:
    """Read the newest version of the store, or the one of that number. The schema is fixed;
    missing fields get their defaults.

    ``complete`` says that the store was written by ``append_entries``, which fills
    the defaults: columns are then read as they are, and filters on them reach the
    Parquet scan. A folder without versions is read as it is.
    """
    held = generations.version(spark, path, number)
    if held.number:
        stored = _pieces(spark, path, held).drop("part")
    else:
        stored = spark.read.schema(ENTRY_SCHEMA).parquet(path)
    return stored if complete else fill_entries(stored)


def normalize_entries(df: DataFrame, ingest_ts: datetime | Column) -> DataFrame:
    """Fill what a writer must set: language, upload time and leader key."""
    when = F.lit(ingest_ts) if isinstance(ingest_ts, datetime) else ingest_ts
    fixes = {
        "language": F.coalesce("language", F.lit("english")),
        "uploaded": F.coalesce(F.col("uploaded"), when),
    }
    if "leader_key" in df.columns:
        fixes["leader_key"] = F.coalesce("leader_key", F.lit(""))
    return df.withColumns(fixes)


def _write_part(df: DataFrame, path: str) -> dict:
    """Write rows as a new part, which no version names yet.

    Rows are spread by range over category and id before the write: a category
    that holds a third of all rows becomes many files, and files cover narrow id
    ranges, so id filters skip whole files.
    """
    name, folder = generations.new_part(path)
    (
        df.repartitionByRange("category", *ID)
        .sortWithinPartitions("category", *ID)
        .write.partitionBy("category")
        .parquet(folder)
    )
    return {"folder": name, "pieces": generations.folder_names(df.sparkSession, folder)}


def append_entries(df: DataFrame, path: str) -> None:
    """Add entries to the store, missing fields filled: all of them, or none if the write fails."""
    part = _write_part(fill_entries(df), path)
    generations.change(df.sparkSession, path, lambda base: [*base.parts, part])


def delete_entries(spark: SparkSession, path: str, *predicates: Column) -> None:
    """Delete the rows that satisfy any of the predicates.

    Only pieces that lose rows are written anew, and readers see all of the deletion or nothing.
    Raises ``Conflict`` if the store was changed meanwhile.
    """
    base = generations.version(spark, path)
    rows = _pieces(spark, path, base)
    doomed = any_of([F.coalesce(p, F.lit(False)) for p in predicates])
    # At most one row for each piece.
    losing = {(r[0], r[1]) for r in rows.filter(doomed).select("part", "category").distinct().collect()}
    if not losing:
        return
    touched = rows.filter(F.struct("part", "category").isin([F.struct(F.lit(p), F.lit(c)) for p, c in sorted(losing)]))
    kept = _write_part(touched.filter(~doomed).drop("part"), path)
    lost: dict[str, set[str]] = {}
    for part, category in losing:
        lost.setdefault(f"part={part}", set()).add(_piece(spark, category))
    left = [
        p | {"pieces": [piece for piece in p["pieces"] if piece not in lost.get(p["folder"], ())]} for p in base.parts
    ]
    generations.commit(spark, path, base, [p for p in [*left, kept] if p["pieces"]])


def _piece(spark: SparkSession, category: str) -> str:
    """The folder name that Spark gives to a category."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(category)
    return f"category={escaped}"


def compact_entries(spark: SparkSession, path: str, most_parts: int = MOST_PARTS) -> bool:
    """Write all parts as one if there are more than ``most_parts``. Raises ``Conflict`` if the
    store was changed meanwhile."""
    base = generations.version(spark, path)
    if len(base.parts) <= most_parts:
        return False
    whole = _write_part(_pieces(spark, path, base).drop("part"), path)
    generations.commit(spark, path, base, [whole])
    return True


def truncate(spark: SparkSession, path: str) -> None:
    """Replace the store by an empty one."""
    generations.change(spark, path, lambda base: [])
