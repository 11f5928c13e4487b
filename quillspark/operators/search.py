"""Search over documents and vectors (J12, J13, F10, P9, P16, T-11, T-12, U15)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import lexical_score, searchable
from quillspark.session import ship_package


def facet_filter(surface: str | None = None, topic: str | None = None, story_form: str | None = None) -> Column:
    """Facets as one predicate; ``all`` and an empty value select everything."""
    out = F.lit(True)
    if surface and surface != "all":
        out = out & F.array_contains("surfaces", surface)
    if topic and topic != "all":
        out = out & (F.col("topic") == topic)
    if story_form and story_form != "all":
        out = out & (F.col("story_form") == story_form)
    return out


def cosine_scores(df: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """``df`` with ``score``, its cosine with one query vector, by Arrow batches. A vector of another size or of zeros has no score."""
    ship_package(df.sparkSession)
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        out = np.full(len(v), np.nan)
        fit = np.array([x is not None and len(x) == len(q) for x in v])
        if fit.any():
            m = np.stack(v[fit].to_list()).astype(np.float64)
            n = np.linalg.norm(m, axis=1)
            out[fit] = np.where(n > 0, m @ q / np.where(n > 0, n, 1.0), np.nan)
        return pd.Series(out)

    return df.withColumn("score", F.nanvl(score(column), F.lit(None).cast("double")))


def top_by_score(scored: DataFrame, k: int, tie: str, positive: bool = True) -> DataFrame:
    """The ``k`` best, each executor sending only its own ``k`` (a take-ordered plan); equal scores by ``tie``."""
    rows = scored.where("score is not null")
    if positive:
        rows = rows.where("score > 0")
    return rows.orderBy(F.col("score").desc(), tie).limit(k)


def vector_search(index: DataFrame, query: list[float], k: int = 20, where: Column | None = None) -> DataFrame:
    base = index if where is None else index.where(where)
    return top_by_score(cosine_scores(base, query), k, "story_id")


def related(index: DataFrame, story_id: str, vector: list[float], k: int = 6) -> DataFrame:
    """Nearest documents of other stories; scores may be negative."""
    return top_by_score(cosine_scores(index.where(F.col("story_id") != story_id), vector), k, "story_id", positive=False)


def keyword_search(index: DataFrame, query: str, k: int = 20, where: Column | None = None) -> DataFrame:
    """Documents by share of the query's terms found; for when there is no model to embed a query."""
    terms = query.lower().split()
    base = index if where is None else index.where(where)
    text = searchable(F.col("title"), F.col("summary"), F.col("topic"), F.array_join("themes", " "))
    return top_by_score(base.withColumn("score", lexical_score(F.col("title"), text, terms)), k, "story_id")


def search(index: DataFrame, query: str, embed: Callable[[str], list[float]] | None = None, prefix: str = "", k: int = 20, where: Column | None = None) -> DataFrame:
    """Documents for a query by its vector (U14); by keywords where there is no model or it fails (U15). ``prefix`` is what the model wants before a query. ``index`` has ``embedding`` for the first way."""
    vector = None
    if embed is not None:
        try:
            vector = embed(prefix + query)
        except Exception:  # noqa: BLE001
            vector = None
    return keyword_search(index, query, k, where) if vector is None else vector_search(index, vector, k, where)


def nearest_to_queries(index: DataFrame, queries: DataFrame, id: str, k: int = 5, column: str = "embedding", block: int = 20_000) -> DataFrame:  # noqa: A002
    """``query_id, id, score``: the ``k`` rows of ``index`` most similar to each of a stated set of queries, but itself; equal scores by the smaller id.

    Queries go to the executors in blocks of about ``block``, so a broadcast is bounded; each pass reads the index once, and a batch of
    it sends on only its own ``k`` of each query. Vectors of zeros, null, or of another size than a query's have no score.
    """
    spark = index.sparkSession
    ship_package(spark)
    slim = lambda df: df.select(F.col(id).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("id is not null and v is not null and exists(v, x -> x <> 0) and not exists(v, x -> x is null or isnan(x))")
    q = slim(queries)
    parts = max(1, -(-q.count() // block))
    out = None
    for part in range(parts):
        some = q.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toPandas()
        if not len(some):
            continue
        by_size = {n: (g["id"].to_numpy(), _unit(g["v"])) for n, g in some.groupby(some["v"].map(len))}
        shared = spark.sparkContext.broadcast(by_size)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                for n, g in b.groupby(b["v"].map(len)):
                    if n not in shared.value:
                        continue
                    ids, x = shared.value[n]
                    mine = g["id"].to_numpy()
                    sims = np.round(x @ _unit(g["v"]).T, 12)
                    sims[ids[:, None] == mine[None, :]] = -2.0
                    best = np.lexsort((np.broadcast_to(mine, sims.shape), -sims), axis=1)[:, :k]
                    s = np.take_along_axis(sims, best, 1)
                    keep = s > -2.0
                    yield pd.DataFrame({"query_id": np.repeat(ids, keep.sum(axis=1)), "id": mine[best[keep]], "score": s[keep]})

        found = slim(index).mapInPandas(run, "query_id long, id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def _unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_list()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
