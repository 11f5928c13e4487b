"""Legacy CSV and Parquet files, loose or in ZIPs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.ids import normalize_url, stable_id
from quillspark.functions.text import split_authors
from quillspark.functions.times import from_utc_text, inferred_fetch, iso
from quillspark.sinks.tables import with_day, write_table


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, length, digest, content`` of files below a folder."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return b.select("path", "length", F.sha2("content", 256).alias("digest"), "content")


def payloads(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """``path, name, digest, content`` of files with ``suffix``, loose and inside ZIPs; an archive is opened where it lies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                if path.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in sorted(z.namelist()):
                            if name.lower().endswith(suffix):
                                yield pd.DataFrame({"path": [path], "name": [name], "content": [z.read(name)]})
                elif path.lower().endswith(suffix):
                    yield pd.DataFrame({"path": [path], "name": [path.rsplit("/", 1)[-1]], "content": [content]})

    got = files(spark, folder).select("path", "content").mapInPandas(run, "path string, name string, content binary")
    return got.select("path", "name", F.sha2("content", 256).alias("digest"), "content")


def legacy_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``source, digest, ordinal, timestamp, rank, position, title, link`` of legacy CSVs in file order; a byte order mark is dropped, columns that are missing are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for b in batches:
            for path, name, digest, content in zip(b["path"], b["name"], b["digest"], b["content"], strict=True):
                rows = list(csv.DictReader(io.StringIO(bytes(content).decode("utf-8-sig"))))
                if rows:
                    d = pd.DataFrame(rows).reindex(columns=["timestamp", "rank", "position", "title", "link"]).astype(object)
                    d = d.where(d.notna(), None)
                    yield d.assign(source=f"{path}!{name}", digest=digest, ordinal=range(len(d)))[["source", "digest", "ordinal", "timestamp", "rank", "position", "title", "link"]]

    return payloads(spark, folder, ".csv").mapInPandas(run, "source string, digest string, ordinal long, timestamp string, rank string, position string, title string, link string")


def legacy_parquet(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of legacy Parquet files, loose and inside ZIPs, in ``schema`` with ``source, digest, day``; the day is in the file's name, missing columns are null."""
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    types = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(types)
        for b in batches:
            for path, name, digest, content in zip(b["path"], b["name"], b["digest"], b["content"], strict=True):
                t = pq.read_table(io.BytesIO(bytes(content)))
                cols = [t[f.name].cast(f.type) if f.name in t.column_names else pa.nulls(len(t), f.type) for f in wanted]
                d = pa.table(cols, schema=wanted).to_pandas()
                yield d.assign(source=f"{path}!{name}", digest=digest)[["source", "digest", *names]]

    got = payloads(spark, folder, ".parquet").mapInPandas(run, "source string, digest string, " + schema)
    return got.withColumn("day", F.try_to_date(F.regexp_extract("source", r"(\d{4}-\d{2}-\d{2})[^/!]*$", 1)))


def migrate_days(rows: DataFrame, target: str, at: str, source_commit: str) -> DataFrame:
    """Writes ``rows`` by day below ``target`` and returns its manifest: ``path, digest, bytes, rows, source_commit`` of each file, by which a copy can be checked."""
    spark = rows.sparkSession
    parts = ["year", "month", "day"]
    write_table(with_day(rows, at).repartition(*parts), target, mode="overwrite", partition_by=parts)
    counts = spark.read.parquet(target).groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("rows"))
    tail = lambda c: F.regexp_extract(c, r"([^/]+/[^/]+/[^/]+/[^/]+)$", 1)
    found = files(spark, target, "*.parquet").select(tail("path").alias("path"), "digest", F.col("length").alias("bytes"))
    return found.join(counts.select(tail("path").alias("path"), "rows"), "path", "left").select("path", "digest", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(source_commit).alias("source_commit"))


def dense_positions(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``ordinal``: the running number within a group, which is one list."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def legacy_observations(rows: DataFrame, surface: Column, base: str) -> DataFrame:
    """Observations of legacy rows: the rank or position given, else the running number per time in file order, which advances either way."""
    r = rows.withColumn("observed_at", from_utc_text(F.col("timestamp"))).where("observed_at is not null").withColumn("surface", surface)
    running = F.row_number().over(Window.partitionBy("source", "observed_at").orderBy("ordinal"))
    given = F.nullif(F.coalesce(F.col("rank").try_cast("int"), F.col("position").try_cast("int")), F.lit(0))
    r = r.withColumn("position", F.coalesce(given, running).cast("tinyint")).withColumn("url", normalize_url(F.col("link"), base))
    return r.select("observed_at", "surface", "position", F.trim("title").alias("title"), "url", stable_id(F.col("url")).alias("story_id"), stable_id(iso(F.col("observed_at")), F.col("surface")).alias("scrape_id"))


def legacy_articles(rows: DataFrame, day: Column, first_seen: DataFrame, base: str) -> DataFrame:
    """Article snapshots of legacy rows: fetch times inferred from the day, first sights from observations where they are wrong or missing."""
    a = rows.withColumn("canonical_url", normalize_url(F.col("url"), base)).withColumn("fetched_at", inferred_fetch(day)).withColumn("content_sha256", F.sha2(F.coalesce("article_text", F.lit("")), 256))
    f = first_seen.select(F.col("url").alias("canonical_url"), F.col("first_observed_at").alias("seen"))
    a = a.join(f, "canonical_url", "left")
    return a.select(
        stable_id(F.col("canonical_url"), iso(F.col("fetched_at")), F.col("content_sha256")).alias("snapshot_id"), F.col("url").alias("requested_url"), "canonical_url", stable_id(F.col("canonical_url")).alias("story_id"),
        F.coalesce(F.try_to_timestamp("first_appeared_at"), "seen", "fetched_at").alias("first_observed_at"), "fetched_at", F.lit(True).alias("fetched_at_is_inferred"), F.trim(F.coalesce("title", F.lit(""))).alias("title"),
        F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), F.coalesce("article_text", F.lit("")).alias("article_text"), "content_sha256", F.sha2(F.coalesce("article_html", F.lit("")), 256).alias("html_sha256"),
        F.lit(None).cast("smallint").alias("http_status"), "fetch_ok", "article_html",
    )


def authors_from_text(column: str) -> Column:
    return split_authors(F.col(column))


def source_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "digest").agg(F.count("*").alias("rows"))
