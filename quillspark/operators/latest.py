"""Newest rows by key, keyed upserts and key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``, which must be total for a repeatable result.

    A rank of one is planned with a group limit before the shuffle, so only a row per key and partition travels.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def latest_values(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """As ``latest_by`` with descending plain columns, by a partial aggregation: for narrow values and hot keys."""
    top = F.max(F.struct(*order, *[v for v in values if v not in order])).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_top.{v}").alias(v) for v in values])


def merge_unique(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Upsert: rows of ``incoming`` win, and among rows of one side the last by ``order``. Columns and types are those of ``incoming``.

    Sorted by the text of the keys, as stored shards are.
    """
    old = existing.select(*[F.col(c).cast(t).alias(c) if c in existing.columns else F.lit(None).cast(t).alias(c) for c, t in incoming.dtypes])
    both = old.withColumn("_layer", F.lit(0)).unionByName(incoming.withColumn("_layer", F.lit(1)))
    rank = [F.col("_layer").desc(), *[F.col(c).desc_nulls_last() for c in (order or [])], F.xxhash64(*incoming.columns).desc()]
    merged = latest_by(both, keys, rank).drop("_layer")
    return merged.orderBy(*[F.col(k).cast("string") for k in keys])


def layered(base: DataFrame, *increments: DataFrame) -> DataFrame:
    """A base and its newer shards as one table with ``_layer``; columns that one lacks are null."""
    out = base.withColumn("_layer", F.lit(0))
    for i, part in enumerate(increments, 1):
        out = out.unionByName(part.withColumn("_layer", F.lit(i)), allowMissingColumns=True)
    return out


def not_done(candidates: DataFrame, done: DataFrame, key: str, failed: DataFrame | None = None, retry_failures: bool = False) -> DataFrame:
    """Candidates without a finished row, and without a failed one unless failures are retried."""
    out = candidates.join(done.select(key).distinct(), key, "left_anti")
    if failed is not None and not retry_failures:
        out = out.join(failed.select(key).distinct(), key, "left_anti")
    return out


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side; empty if the sets are equal."""
    left = a.select(key).distinct().withColumn("_a", F.lit(1))
    right = b.select(key).distinct().withColumn("_b", F.lit(1))
    return left.join(right, key, "full_outer").where("_a is null or _b is null").select(key, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))


def unique_articles(articles: DataFrame) -> DataFrame:
    """One row per content: the newest good fetch (P6, T-16)."""
    good = articles.where("fetch_ok and content_sha256 <> ''")
    return latest_by(good, ["content_sha256"], [F.col("fetched_at").desc(), F.col("snapshot_id").desc()])


def newest_signals(signals: DataFrame) -> DataFrame:
    return latest_by(signals, ["content_sha256"], [F.col("generated_at").desc(), F.col("prompt_version").desc(), F.xxhash64("event_label", "topic", "event_type", "story_form").desc()])
