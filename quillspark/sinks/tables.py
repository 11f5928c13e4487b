"""Stored tables: typed Parquet by day, upserts, shards, compaction, JSON and binary marts."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.operators.latest import latest_by, merge_unique


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Parquet by zstd at level 9, as what is stored is read far more often than written."""
    w = df.write.mode(mode).option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def with_day(df: DataFrame, at: str) -> DataFrame:
    """``df`` with the partition columns ``year, month, day``."""
    return df.withColumns({"year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM"), "day": F.date_format(at, "yyyy-MM-dd")})


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{source} can't be renamed to {target}")


def upsert_days(incoming: DataFrame, target: str, keys: list[str], at: str, order: list[str] | None = None) -> int:
    """Merges rows into the day partitions they belong to; others aren't touched. Returns the rows these days hold then.

    Merged days are written beside the table first, as they are made from what they replace, then moved in by dynamic overwrite.
    """
    spark = incoming.sparkSession
    new = with_day(incoming, at)
    parts = ["year", "month", "day"]
    if exists(spark, target):
        days = new.select("day").distinct()
        text = new.schema
        old = spark.read.schema(text).parquet(target).join(F.broadcast(days), "day", "left_semi").select(*new.columns)
    else:
        old = new.limit(0)
    staged = f"{target.rstrip('/')}.staged-{uuid.uuid4().hex}"
    write_table(merge_unique(old, new, keys, order or [at]).repartition(*parts), staged, partition_by=parts)
    ready = spark.read.schema(new.schema).parquet(staged)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*parts).parquet(target)
    merged = ready.count()
    delete(spark, staged)
    return merged


def publish_captures(observations: DataFrame, runs: DataFrame, root: str) -> dict[str, int]:
    """Upserts the rows of captures and of their runs, both by day; returns the rows their days hold. An empty batch of observations is refused before anything is written."""
    if observations.isEmpty():
        raise ValueError("no observations to publish")
    return {
        "observations": upsert_days(observations, f"{root}/observations", schemas.KEYS["observations"], "observed_at"),
        "scrape_runs": upsert_days(runs, f"{root}/scrape_runs", schemas.KEYS["scrape_runs"], "started_at", ["completed_at"]),
    }


def typed(rows: list[dict], name: str, spark: SparkSession) -> DataFrame:
    """Records as rows of the declared table ``name``; fields it doesn't declare (a page in articles) are left out."""
    schema = schemas.TABLES[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def split_articles(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The public part of article rows, without the page, and its companion with it (K5)."""
    return articles.drop("article_html"), articles.select("snapshot_id", "canonical_url", "fetched_at", "article_html", "html_sha256").where("article_html is not null")


def pause_for(error: Exception, delay: float = 5.0, limited: float = 60.0, commits: float = 3600.0) -> float:
    """Seconds to wait after an error: longer where a store says that requests are limited (429), an hour where commits are."""
    text = str(error).lower()
    if "429" not in text and "too many requests" not in text:
        return delay
    return max(delay, commits if "commit" in text else limited)


def append_shard(df: DataFrame, prefix: str, identity: str, attempts: int = 2, wait: Callable[[float], None] = time.sleep, delay: float = 5.0) -> str:
    """Writes an immutable shard named by the time and a digest of its rows' identities; tries again after a pause. Returns its path.

    The digest is of the number of different identities and the sums of their hashes, so no list of them is formed.
    """
    h = df.select(F.col(identity).cast("string").alias("i")).distinct()
    sums = h.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("i"), 16)), F.sum(F.shiftright(F.xxhash64("i", F.lit(1)), 16))).head()
    digest = hashlib.sha256("|".join(str(x) for x in sums).encode()).hexdigest()[:16]
    path = f"{prefix.rstrip('/')}/shards/{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{digest}"
    for left in reversed(range(attempts)):
        try:
            write_table(df, path, mode="overwrite")
            return path
        except Exception as e:
            if not left:
                raise
            wait(pause_for(e, delay))
    return path


def _versions(spark: SparkSession, prefix: str) -> list[int]:
    fs, p = _fs(spark, f"{prefix}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit())


def _version(spark: SparkSession, prefix: str) -> tuple[int, dict]:
    """The newest version of a prefix: its number, its base and the shards that are in it."""
    found = _versions(spark, prefix)
    if not found:
        return 0, {"base": "base" if exists(spark, f"{prefix}/base") else None, "taken": []}
    fs, p = _fs(spark, f"{prefix}/versions/{found[-1]}")
    stream = fs.open(p)
    try:
        return found[-1], json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def live_paths(spark: SparkSession, prefix: str) -> list[str]:
    """What a prefix consists of: the base of its newest version, then the shards that aren't in it, in order of their names."""
    _, v = _version(spark, prefix)
    fs, p = _fs(spark, f"{prefix}/shards")
    shards = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
    return [*([f"{prefix}/{v['base']}"] if v["base"] else []), *(f"{prefix}/shards/{n}" for n in shards if n not in set(v["taken"]))]


def compact(spark: SparkSession, prefix: str, key: str | None = None, order: str | None = None, expected_version: int | None = None) -> DataFrame:
    """Base and shards of a prefix into a new base, newest row by ``key`` if given; ``version, rows, files`` before and after.

    The new base is written under a name of its own and becomes the base when the next version's file is created, which only
    one compaction can do, whenever it stops. The version names the shards it holds, so shards that come
    in meanwhile stay, and those not yet deleted aren't read twice.
    """
    now, old = _version(spark, prefix)
    if expected_version is not None and now != expected_version:
        raise RuntimeError(f"version {now} instead of {expected_version}")
    paths = live_paths(spark, prefix)
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    files = df.inputFiles()
    out = latest_by(df, [key], [F.col(order).desc(), F.xxhash64(*df.columns).desc()]) if key else df
    base = f"base-{uuid.uuid4().hex}"
    write_table(out, f"{prefix}/{base}")
    done = spark.read.parquet(f"{prefix}/{base}")
    counts = (now + 1, df.count(), done.count(), len(files), len(done.inputFiles()))
    taken = [p.rsplit("/", 1)[1] for p in paths if "/shards/" in p]
    fs, marker = _fs(spark, f"{prefix}/versions/{now + 1}")
    _, staged = _fs(spark, f"{prefix}/versions/.{uuid.uuid4().hex}")
    stream = fs.create(staged, True)
    stream.write(bytearray(json.dumps({"base": base, "taken": taken}).encode()))
    stream.close()
    if fs.exists(marker) or not fs.rename(staged, marker):
        fs.delete(staged, True)
        delete(spark, f"{prefix}/{base}")
        raise RuntimeError("another compaction was faster")
    if old["base"]:
        delete(spark, f"{prefix}/{old['base']}")
    for name in [*taken, *old["taken"]]:
        delete(spark, f"{prefix}/shards/{name}")
    return spark.createDataFrame([counts], "version long, rows_before long, rows_after long, files_before long, files_after long")


def write_json(df: DataFrame, path: str) -> None:
    """A mart as JSON lines, in parallel; order within files is that of the rows."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def vector_blob(index: DataFrame, vector: str = "vector", order: str = "story_id") -> bytes:
    """Row-major bytes of quantised vectors in order. For an index that one client loads; rows come partition by partition."""
    out = bytearray()
    for row in index.select(order, vector).orderBy(order).toLocalIterator():
        out += bytes(x & 0xFF for x in row[1])
    return bytes(out)


def manifest_json(values: dict) -> str:
    return json.dumps(values, sort_keys=True, separators=(",", ":"), default=str) + "\n"


def save_as_table(df: DataFrame, name: str, comment: str) -> None:
    df.write.mode("overwrite").format("parquet").saveAsTable(name)
    df.sparkSession.sql(f"COMMENT ON TABLE {name} IS '{comment.replace(chr(39), chr(39) * 2)}'")
