"""Micro-batches of delivered rows upserted into stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillspark import schemas
from quillspark.sinks.tables import publish_captures, upsert_days


def read_deliveries(spark: SparkSession, folder: str, name: str, max_files: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear below ``folder``, in the declared schema of table ``name``."""
    return spark.readStream.schema(schemas.TABLES[name]).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").parquet(folder)


def upsert_stream(rows: DataFrame, target: str, keys: list[str], at: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upserts a stream by day partitions. The newest row of a key wins, as a batch may be delivered again; the checkpoint keeps what is done."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            upsert_days(df, target, keys, at)

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def publish_stream(observations: DataFrame, runs: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Publishes micro-batches of captures: their rows and, by ``runs`` from these, the runs they belong to, both upserted. An empty batch is none."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            publish_captures(df, runs(df), root)

    writer = observations.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
