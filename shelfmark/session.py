"""Session settings, and the shared folder in which work is made durable."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def local_session(
    folder: str, cores: str = "8", app: str = "shelfmark", memory: str = "8g"
) -> SparkSession:
    """A session for tests and benchmarks, with its own folder for durable tables. On a cluster
    use the session that is given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.checkpoint.dir", folder)
    )
    for key, value in SESSION_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.removesuffix("/")


@contextmanager
def settings(spark: SparkSession, wanted: Mapping[str, object]) -> Iterator[None]:
    """Settings for what is run inside; the session's own come back after it."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and go on from the written copy.

    This cuts the lineage as a checkpoint does, survives lost executors, and computes
    ``df`` once (an eager checkpoint computes it a second time to save it).
    """
    path = work_dir(df.sparkSession, "durable")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, dealt anew by their keys if the largest task has more than twice its share.

    A file is read in tasks of whole row groups: one with few of them keeps most cores idle, however
    much there is to do for each row. Counting rows reads no columns.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    most, total = tasks.agg(F.max("n"), F.sum("n")).first()
    if total is None or most * cores <= 2 * total:
        return rows
    return rows.repartition(4 * cores, *keys)
