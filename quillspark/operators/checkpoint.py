"""Results and failures of an enrichment run, kept by content between runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.latest import latest_by
from quillspark.sinks.tables import delete, exists, rename, write_table

RESULTS = "content_sha256 string, payload string, generated_at timestamp"
FAILURES = "content_sha256 string, error string, failed_at timestamp"


class Checkpoint:
    """Two small Parquet tables below a folder. A result replaces an older one and clears the content's failure; each write is staged and swapped in."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _swap(self, name: str, df: DataFrame) -> None:
        path, staged = f"{self.folder}/{name}", f"{self.folder}/{name}.staged-{uuid.uuid4().hex}"
        write_table(df, staged)
        delete(self.spark, path)
        rename(self.spark, staged, path)

    def record(self, rows: DataFrame, key: str = "content_sha256") -> None:
        """``rows`` as JSON payloads under their key, newest first to hold."""
        new = rows.select(F.col(key).alias("content_sha256"), F.to_json(F.struct(*rows.columns)).alias("payload"), F.current_timestamp().alias("generated_at"))
        both = self._read("results", RESULTS).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        self._swap("results", latest_by(both, ["content_sha256"], [F.col("_new").desc(), F.col("generated_at").desc(), F.xxhash64("payload").desc()]).drop("_new"))
        self._swap("failures", self._read("failures", FAILURES).join(self._read("results", RESULTS), "content_sha256", "left_anti"))

    def record_failures(self, rows: DataFrame) -> None:
        """``rows`` has ``content_sha256, error``; texts are cut to 2,000 characters."""
        new = rows.select("content_sha256", F.substring("error", 1, 2000).alias("error"), F.current_timestamp().alias("failed_at"))
        both = self._read("failures", FAILURES).unionByName(new)
        self._swap("failures", latest_by(both, ["content_sha256"], [F.col("failed_at").desc(), F.col("error").desc()]))

    def results(self, schema: str) -> DataFrame:
        """Recorded rows in the given schema."""
        return self._read("results", RESULTS).select(F.from_json("payload", schema).alias("r")).select("r.*")

    def failures(self) -> DataFrame:
        return self._read("failures", FAILURES)
