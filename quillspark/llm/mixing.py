"""Sources mixed to target shares of all tokens, by systematic sampling.

The size of a mix is the largest at which no source has to repeat a text more often than allowed. A source's expected
copies of each text are then its target over its tokens. Texts of a source stand in order of size; expected copies are
summed up along the order, one random offset is added, and a copy comes out for each whole number that is crossed. So a
text is used floor or ceiling of its expected copies, sizes are met to within a text, and the order spreads over all sizes.

A text's place in its source needs no sort of the source: places within (source, size, stretch of the hash) are added
to prefix sums of the counts of those cells, so a source with a third of all rows is spread over its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.tokens import TOKENIZER, token_sizes
from quillspark.session import ship_package, written

def usable_targets(targets: DataFrame) -> DataFrame:
    """One row per (mix_name, source): repeated rows count once, of rows that differ the greater share, then the greater limit, holds. Shares that are null or not above 0, and limits below 1, are none."""
    ok = targets.where("mix_name is not null and source is not null and target_share > 0 and max_repeats >= 1 and not isnan(target_share)")
    return ok.groupBy("mix_name", "source").agg(F.max(F.struct("target_share", "max_repeats")).alias("x")).select("mix_name", "source", "x.target_share", "x.max_repeats")


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``mix_name, source, target_share, max_repeats, source_tokens, texts, copies``: expected copies of each text of a source.

    Shares are taken relative to their sum. Without ``total_tokens`` a mix is as large as its scarcest source that has
    texts allows; with it, a source gives at most its limit. A source without texts gives nothing.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("texts"))
    t = usable_targets(targets)
    w = Window.partitionBy("mix_name")
    t = t.withColumn("share", F.col("target_share") / F.sum("target_share").over(w)).join(have, "source", "left")
    most = F.min(F.col("max_repeats") * F.col("source_tokens") / F.col("share")).over(w)  # nulls, sources without texts, don't count
    size = F.lit(float(total_tokens)) if total_tokens is not None else most
    copies = F.least(F.col("max_repeats").cast("double"), F.col("share") * size / F.col("source_tokens"))
    return t.select("mix_name", "source", "target_share", "max_repeats", F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce(copies, F.lit(0.0)).alias("copies"))


def places(sizes: DataFrame, cell: int = 50_000) -> DataFrame:
    """``doc_id, source, tokens, place``: the place of each text in its source by (tokens, hash, doc_id), from 1."""
    h = F.xxhash64("doc_id")
    hot = sizes.groupBy("source", "tokens").agg(F.ceil(F.count("*") / F.lit(cell)).alias("k")).where("k > 1")
    s = sizes.withColumn("h", h).join(hot, ["source", "tokens"], "left")
    # Stretches of the hash's range, in its order.
    stretch = F.coalesce(F.floor((F.shiftright(F.col("h"), 32) + F.lit(2**31)) * F.col("k") / F.lit(2**32)), F.lit(0)).cast("long")
    s = s.withColumn("c", stretch)
    cells = s.groupBy("source", "tokens", "c").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("source").orderBy("tokens", "c").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0))).drop("n")
    within = Window.partitionBy("source", "tokens", "c").orderBy("h", "doc_id")
    return s.withColumn("i", F.row_number().over(within)).join(cells, ["source", "tokens", "c"]).select("doc_id", "source", "tokens", (F.col("before") + F.col("i")).alias("place"))


def select_mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: int | None = None, seed: int = 1) -> DataFrame:
    """``mix_name, source, doc_id, tokens, copies``: the texts of each mix and how often each is used (at least once).

    Documents without tokens or of sources that no mix names don't come out; empty tables give no rows. The same ``seed``
    gives the same selection however the data are partitioned.
    """
    ship_package(documents.sparkSession)
    sizes = written(token_sizes(documents, tokenizer))
    return _select(sizes, targets, total_tokens, seed)


def _copies(offset: Column) -> Column:
    """A copy for each whole number in (c * (place - 1) + offset, c * place + offset]."""
    return F.floor(F.col("c") * F.col("place") + offset) - F.floor(F.col("c") * (F.col("place") - 1) + offset)


def _select(sizes: DataFrame, targets: DataFrame, total_tokens: int | None, seed: int) -> DataFrame:
    u = F.pmod(F.xxhash64(F.lit(seed), "mix_name", "source"), F.lit(2**40)) / F.lit(float(2**40))
    p = plan(sizes, targets, total_tokens).where("copies > 0").select("mix_name", "source", F.col("copies").alias("c"), u.alias("u"))
    # Targets are configuration: a row per source of a mix, however many documents there are.
    copies = _copies(F.col("u")).cast("int").alias("copies")
    return places(sizes).join(p, "source").select("mix_name", "source", "doc_id", "tokens", copies).where("copies > 0")


def share_report(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: int | None = None, seed: int = 1) -> DataFrame:
    """``mix_name, source, target_share, reached_share, tokens, texts, max_repeats, most_copies, mean_copies``, also for sources without texts."""
    ship_package(documents.sparkSession)
    sizes = written(token_sizes(documents, tokenizer))
    got = _select(sizes, targets, total_tokens, seed).groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    p = plan(sizes, targets, total_tokens).select("mix_name", "source", "target_share", "max_repeats", F.col("copies").alias("mean_copies"))
    all_ = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy("mix_name"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return p.join(got, ["mix_name", "source"], "left").select("mix_name", "source", "target_share", F.coalesce(F.col("tokens") / F.nullif(all_, F.lit(0)), F.lit(0.0)).alias("reached_share"), zero("tokens"), zero("texts"), "max_repeats", zero("most_copies"), "mean_copies")
