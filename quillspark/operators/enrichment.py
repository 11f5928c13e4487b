"""Incremental enrichment: work sets, shards, usage and budget prefixes, pluggable models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.numbers import split_evenly
from quillspark.operators.latest import not_done, unique_articles


def work_set(articles: DataFrame, done: DataFrame, model: str, version_column: str, version: str, failed: DataFrame | None = None, retry_failures: bool = False, limit: int = 0) -> DataFrame:
    """Good contents, oldest first, without a finished row of this model and version; ``limit`` 0 is all (P20, T-17)."""
    finished = done.where((F.col("model") == model) & (F.col(version_column) == version))
    todo = not_done(unique_articles(articles), finished, "content_sha256", failed, retry_failures).orderBy("fetched_at", "content_sha256")
    return todo.limit(limit) if limit else todo


def numbered(df: DataFrame, order: list[str], cell: int = 100_000) -> DataFrame:
    """``df`` with ``ordinal`` from 0 in a total order, without one task that sorts everything.

    Rows are ranged by the order, counted per range, and numbered within; ranges follow the data's size.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order)
    from quillspark.session import written

    ranged = written(ranged)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy("_part").orderBy(*order)
    return ranged.withColumn("_i", F.row_number().over(w)).join(F.broadcast(before), "_part").withColumn("ordinal", F.col("_before") + F.col("_i") - 1).drop("_part", "_i", "_before")


def assign_shards(df: DataFrame, order: list[str], size: int = 256, force: bool = False) -> DataFrame:
    """``df`` with ``shard``: full shards of ``size`` rows in order; the rest only with ``force``."""
    n = numbered(df, order).withColumn("shard", F.floor(F.col("ordinal") / F.lit(size)))
    if force:
        return n
    full = n.groupBy("shard").agg(F.count("*").alias("_n")).where(F.col("_n") == size).select("shard")
    return n.join(full, "shard", "left_semi")


def shard_digest(identities: Column) -> Column:
    """The first 16 hex digits over the sorted identities of a shard's rows, one a line."""
    return F.substring(F.sha2(F.array_join(F.array_sort(identities), "\n"), 256), 1, 16)


def allocate_usage(rows: DataFrame, batch: str, order: list[str], totals: list[str]) -> DataFrame:
    """Counts of a batch split over its rows so that they add up again; the first rows get what is left over."""
    w = Window.partitionBy(batch)
    i = F.row_number().over(w.orderBy(*order)) - 1
    n = F.count("*").over(w)
    return rows.withColumns({"batch_size": n, **{f"row_{t}": split_evenly(F.col(t), n, i) for t in totals}})


def distinct_sum(rows: DataFrame, keys: list[str], amount: str, group: list[str] | None = None) -> DataFrame:
    """Sum of an amount that repeated rows carry, each key once (A19). Exact: added as decimals of ten places."""
    once = rows.groupBy(*(group or []), *keys).agg(F.max(F.col(amount).cast("decimal(38,10)")).alias("_a"))
    return once.groupBy(*(group or [])).agg(F.sum("_a").cast("decimal(38,10)").alias("total"), F.count("*").alias("records"))


def affordable_prefix(rows: DataFrame, amount: str, order: list[str], budget: float) -> DataFrame:
    """Rows in order as long as the running amount stays within the budget (W6). Only rows that may be within reach are ordered.

    The running sum is a prefix sum over ranges of the order, so no task sees all rows.
    """
    from quillspark.session import written

    ranged = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    d = F.col(amount).cast("decimal(38,10)")
    parts = ranged.groupBy("_part").agg(F.sum(d).alias("_s"))
    before = parts.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("decimal(38,10)"))).drop("_s").where(F.col("_before") <= F.lit(budget).cast("decimal(38,10)"))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = ranged.join(F.broadcast(before), "_part")
    return near.withColumn("running", (F.col("_before") + F.sum(d).over(w)).cast("decimal(38,10)")).where(F.col("running") <= F.lit(budget).cast("decimal(38,10)")).drop("_part", "_before")


def embed(df: DataFrame, text: str, model: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int, batch: int = 128) -> DataFrame:
    """``df`` with ``embedding`` of length one. ``model`` builds, once per task and only if there are rows, a function from texts to vectors.

    A vector of another size or of zeros raises an error, as stored vectors must be usable (M1).
    """
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        encode = None
        for b in batches:
            if not len(b):
                continue
            encode = encode or model()
            out = []
            for at in range(0, len(b), batch):
                for v in encode(b[text].iloc[at : at + batch].tolist()):
                    x = np.asarray(v, np.float64)
                    n = np.linalg.norm(x)
                    if len(x) != dim or not n:
                        raise ValueError(f"a vector of {len(x)} numbers and length {n}; {dim} numbers are needed")
                    out.append((x / n).astype(np.float32))
            yield b.assign(embedding=out)

    return df.mapInPandas(run, schema)


def label(df: DataFrame, key: str, text: str, client: Callable[[], Callable[[list[tuple[str, str]]], str]], batch: int = 8, concurrency: int = 4, attempts: int = 2) -> DataFrame:
    """``key, response, error``: answers of an injected labelling client to batches of up to ``batch`` texts, up to ``concurrency`` at once in a task.

    A failing batch is tried again up to ``attempts`` times in all, then gives rows with an error, not a failed job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = None

        def answer(part: pd.DataFrame) -> pd.DataFrame:
            for left in reversed(range(attempts)):
                try:
                    return pd.DataFrame({key: part[key], "response": ask(list(zip(part[key], part[text], strict=True))), "error": None})
                except Exception as e:  # noqa: BLE001
                    if not left:
                        return pd.DataFrame({key: part[key], "response": None, "error": str(e)[:2000]})
            return part.iloc[:0]

        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                if len(b):
                    ask = ask or client()
                    yield from pool.map(answer, [b.iloc[at : at + batch] for at in range(0, len(b), batch)])

    return df.select(key, text).mapInPandas(run, f"{key} string, response string, error string")


def fresh_cache(entries: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Entries of a response cache that haven't expired."""
    return entries.where(F.col("stored_at") > now - F.make_interval(hours=F.lit(hours)))
