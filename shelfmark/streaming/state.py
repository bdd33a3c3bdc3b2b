"""State of ``foreachBatch`` operators as tables in the shared folder.

Every micro-batch writes its own folder, by overwrite: a batch that is run again
after a failure replaces its own output and reads the same state as before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfmark.sources.generations import folder_names, remove

# After this many batches the deltas are merged into one snapshot.
SNAPSHOT_EVERY = 20


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def write_batch(df: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Write one batch folder and return it as stored."""
    target = f"{path}/batch={batch_id}"
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Everything the batches have written, with the batch number."""
    return spark.read.parquet(path)


@dataclass(frozen=True)
class DeltaTable:
    """A keyed table kept as deltas per batch, merged into a snapshot now and then.

    ``merge`` turns the union of snapshot and deltas into the current rows.
    """

    path: str
    schema: T.StructType
    merge: Callable[[DataFrame], DataFrame]
    every: int = SNAPSHOT_EVERY

    def before(
        self,
        spark: SparkSession,
        batch_id: int,
        keep: Column | Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """The rows as they were before ``batch_id``, those that ``keep`` holds for or gives.

        Writes a snapshot of them when one is due, so that rows which no later batch needs
        do not stay for ever.
        """

        def kept(rows: DataFrame) -> DataFrame:
            if keep is None:
                return rows
            return rows.filter(keep) if isinstance(keep, Column) else keep(rows)

        base = batch_id // self.every * self.every
        if base and base == batch_id:
            current = kept(self.merge(self._since(spark, base - self.every, base)))
            current.write.mode("overwrite").parquet(f"{self.path}/snapshot={base}")
        return kept(self.merge(self._since(spark, base, batch_id)))

    def _since(self, spark: SparkSession, base: int, batch_id: int) -> DataFrame:
        folders = [f"{self.path}/delta={b}" for b in range(base, batch_id)]
        if base > 0:
            folders.append(f"{self.path}/snapshot={base}")
        if not folders:
            return empty(spark, self.schema)
        return spark.read.schema(self.schema).parquet(*folders)

    def add(self, delta: DataFrame, batch_id: int) -> None:
        cols = [f.name for f in self.schema.fields]
        delta.select(*cols).write.mode("overwrite").parquet(f"{self.path}/delta={batch_id}")

    def added(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What a batch added, as stored."""
        return spark.read.schema(self.schema).parquet(f"{self.path}/delta={batch_id}")


@dataclass(frozen=True)
class BlockTable:
    """A table in numbered blocks. A batch writes the whole of each block that it changes, as a
    version under its own number, and reads the versions before it.

    A batch costs in proportion to its blocks, however many there are. Of each block the version
    before the last one stays, so that the last batch can be run again.
    """

    path: str
    schema: T.StructType

    def _versions(self, spark: SparkSession, block: int) -> list[int]:
        names = folder_names(spark, f"{self.path}/block={block}")
        return sorted(int(n.removeprefix("batch=")) for n in names)

    def before(self, spark: SparkSession, blocks: Iterable[int], batch_id: int) -> DataFrame:
        """The rows of some blocks as they were before ``batch_id``."""
        folders = []
        for block in blocks:
            earlier = [v for v in self._versions(spark, block) if v < batch_id]
            if earlier:
                folders.append(f"{self.path}/block={block}/batch={earlier[-1]}")
        if not folders:
            return empty(spark, self.schema)
        return spark.read.schema(self.schema).parquet(*folders)

    def write(self, rows: DataFrame, block: Column, blocks: Iterable[int], batch_id: int) -> None:
        """Write the whole of ``blocks``: rows, and the number of the block of each."""
        cols = [f.name for f in self.schema.fields]
        placed = rows.select(*cols, block.alias("block"), F.lit(batch_id).alias("batch"))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "block", "batch"
        ).parquet(self.path)
        for number in blocks:
            for old in [v for v in self._versions(rows.sparkSession, number) if v < batch_id][:-1]:
                remove(rows.sparkSession, f"{self.path}/block={number}/batch={old}")


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Run ``each`` on all data that is available now."""
    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of the stream to a Parquet folder."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def max_per_key(keys: list[str], value: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.groupBy(*keys).agg(F.max(value).alias(value))
