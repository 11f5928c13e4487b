"""Which records were added, removed or changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import written


def row_hash(columns: list[str]) -> Column:
    """A 64-bit hash of the canonical form of ``columns``: each value as text, with nulls told apart from any text."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit(""))]
    return F.xxhash64(*parts)


def previous_snapshots(snapshots: DataFrame, snapshot: str, at: str, max_gap_seconds: int) -> DataFrame:
    """``snapshot, previous``: each snapshot with the one right before it, if that is at most ``max_gap_seconds`` older.

    ``snapshots`` has one row per snapshot with its instant. Snapshots of one instant follow each other by id.
    There is no window over all snapshots: time is cut into slots of the largest gap allowed, each slot also sees the
    slot before it, and an older predecessor doesn't count anyway. A slot is bounded by how often snapshots are taken.
    """
    gap = max_gap_seconds * 1_000_000
    us = F.unix_micros(F.col(at))
    slot = F.floor(us / F.lit(gap))
    rows = snapshots.where(F.col(snapshot).isNotNull() & F.col(at).isNotNull()).select(
        F.col(snapshot).alias("_id"), us.alias("_us"), F.explode(F.array(slot, slot + 1)).alias("_slot"), slot.alias("_own")
    )
    w = Window.partitionBy("_slot").orderBy("_us", "_id")
    return (
        rows.withColumn("_prev", F.lag("_id").over(w))
        .withColumn("_prev_us", F.lag("_us").over(w))
        .where((F.col("_slot") == F.col("_own")) & (F.col("_us") - F.col("_prev_us") <= gap))
        .select(F.col("_id").alias(snapshot), F.col("_prev").alias("previous"))
    )


def diff_snapshots(rows: DataFrame, pairs: DataFrame, snapshot: str, keys: list[str], values: list[str]) -> DataFrame:
    """``snapshot, *keys, change, *before_v, *after_v`` for each record that differs from the snapshot before.

    ``rows`` has one row per (snapshot, keys); ``pairs`` is what ``previous_snapshots`` returns. Both sides are keyed by
    the later snapshot and the primary key and meet in one full outer join: a missing side is ``added`` or ``removed``,
    unequal row hashes are ``changed``; equal rows don't come out. A record with a null in a key is compared like any
    other value. Columns of ``rows`` besides those named are ignored, whatever they are called. Empty inputs give no rows.
    """
    slim = rows.select(F.col(snapshot).alias("_snap"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)], row_hash(values).alias("_h"))
    p = pairs.select(F.col(snapshot).alias("_later"), F.col("previous").alias("_earlier"))
    after = slim.join(p, slim["_snap"] == p["_later"]).select("_later", *[f"_k{i}" for i in range(len(keys))], F.struct("_h", *[f"_v{i}" for i in range(len(values))]).alias("a"))
    before = slim.join(p, slim["_snap"] == p["_earlier"]).select("_later", *[f"_k{i}" for i in range(len(keys))], F.struct("_h", *[f"_v{i}" for i in range(len(values))]).alias("b"))
    # A null key becomes a pair of columns so that the join stays an equi-join on whole keys.
    def keyed(df: DataFrame, side: str) -> DataFrame:
        cols = ["_later", *[f"_k{i}" for i in range(len(keys))]]
        flags = [F.col(f"_k{i}").isNull().alias(f"_n{i}") for i in range(len(keys))]
        return df.select(*cols, *flags, side).select(*cols, *[f"_n{i}" for i in range(len(keys))], side)

    a, b = keyed(after, "a").alias("x"), keyed(before, "b").alias("y")
    on = F.col("x._later") == F.col("y._later")
    for i in range(len(keys)):
        on = on & F.col(f"x._k{i}").eqNullSafe(F.col(f"y._k{i}"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a._h") != F.col("b._h"), "changed")
    return (
        a.join(b, on, "full_outer")
        .withColumn("change", change)
        .where("change is not null")
        .select(
            F.coalesce("x._later", "y._later").alias(snapshot),
            *[F.when(F.col("a").isNull(), F.col(f"y._k{i}")).otherwise(F.col(f"x._k{i}")).alias(k) for i, k in enumerate(keys)],
            "change",
            *[F.col(f"b._v{i}").alias(f"before_{v}") for i, v in enumerate(values)],
            *[F.col(f"a._v{i}").alias(f"after_{v}") for i, v in enumerate(values)],
        )
    )


def succeeded_scrapes(runs: DataFrame) -> DataFrame:
    """``scrape_id`` of the runs whose latest-completed row succeeded; of rows completed at once the later started holds, then the successful one. A null ``completed_at`` is the oldest, a null ``success`` is a failure."""
    last = F.max(F.struct("completed_at", "started_at", F.coalesce("success", F.lit(False)).alias("ok"))).alias("last")
    return runs.where("scrape_id is not null").groupBy("scrape_id").agg(last).where("last.ok").select("scrape_id")


def list_changes(observations: DataFrame, runs: DataFrame, max_gap_hours: int = 6) -> DataFrame:
    """``scrape_id, surface, story_id, change``: what is new, gone or at another place in each capture.

    A capture is the rows of a succeeded ``scrape_id``, at its earliest ``observed_at``. Repeated rows count once, a
    story listed twice on a surface stands at its smallest position, a null position is after every other one, and rows
    without scrape_id, surface, story_id or observed_at are no observations. Captures that are more than
    ``max_gap_hours`` younger than the one before give nothing.
    """
    o = observations.select("scrape_id", "surface", "story_id", "position", "observed_at").where("scrape_id is not null and surface is not null and story_id is not null and observed_at is not null")
    o = o.join(succeeded_scrapes(runs), "scrape_id", "left_semi")
    # Read three times below: for the snapshots and as the later and the earlier side.
    rows = written(o.groupBy("scrape_id", "surface", "story_id").agg(F.min("position").alias("position"), F.min("observed_at").alias("observed_at")))
    snapshots = rows.groupBy("scrape_id").agg(F.min("observed_at").alias("observed_at"))
    pairs = previous_snapshots(snapshots, "scrape_id", "observed_at", max_gap_hours * 3600)
    diff = diff_snapshots(rows, pairs, "scrape_id", ["surface", "story_id"], ["position"])
    return diff.select("scrape_id", "surface", "story_id", F.when(F.col("change") == "changed", "moved").otherwise(F.col("change")).alias("change"))
