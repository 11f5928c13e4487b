"""Runs of consecutive, nearly identical observations collapsed into one record each.

Method. Row numbers within entity and within entity-and-value: where their difference stays the same, neighbouring
observations carry the same value, so (value, difference) names an exact run. A run in the sense wanted here also takes
in values near that of its FIRST observation, which no difference of row numbers shows. So exact runs are collapsed
first, then each gets the canonical value "start of the run it belongs to", and equal canonical values are aggregated.

Scale. One story may hold a third of all rows, so nothing is grouped by story alone:

1. Rows are spread by (story, surface, slot of time) and collapsed to exact runs there. No task sees more of a story than
   the captures of one slot.
2. The canonical value depends on what went before only through one number, the anchor position. An arriving anchor
   goes on only if it is within the tolerance of the slot's first position, so a slot is folded once for each of those
   2 * tolerance + 1 anchors. All but one of these folds soon agree.
3. One row per slot (not its runs) goes to a fold over slots in time order, which picks the fold that applies.
4. Runs that cross slots are added up by a partial aggregation on (story, surface, start).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import ship_package, written

RUN = "struct<anchor:int,started:bigint,ended:bigint,n:bigint>"


def exact_runs(points: DataFrame, entity: list[str], at: str, value: str, gap: int) -> DataFrame:
    """``*entity, value, started, ended, n``: stretches of one value without a gap, by the difference of row numbers.

    ``points`` has one row per (entity, at) and must be partitioned by a subset of ``entity`` already, then this adds no shuffle.
    """
    by_time = Window.partitionBy(*entity).orderBy(at)
    p = points.withColumn("_rn", F.row_number().over(by_time)).withColumn("_cut", (F.coalesce(F.col(at) - F.lag(at).over(by_time), F.lit(0)) > gap).cast("int"))
    p = p.withColumn("_stretch", F.sum("_cut").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    by_value = Window.partitionBy(*entity, "_stretch", value).orderBy(at)
    p = p.withColumn("_diff", F.col("_rn") - F.row_number().over(by_value))
    return p.groupBy(*entity, "_stretch", value, "_diff").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n")).drop("_stretch", "_diff")


def _fold(runs: Column, shift: int, tolerance: int, gap: int) -> Column:
    """The runs of a slot for an anchor that arrives ``shift`` above the slot's first position."""
    first = F.element_at(runs, 1)
    start = F.array(F.struct((first["value"] + F.lit(shift)).cast("int").alias("anchor"), first["started"].alias("started"), first["ended"].alias("ended"), first["n"].cast("bigint").alias("n"))).cast(f"array<{RUN}>")

    def step(done: Column, r: Column) -> Column:
        cur = F.element_at(done, -1)
        joins = (F.abs(r["value"] - cur["anchor"]) <= tolerance) & (r["started"] - cur["ended"] <= gap)
        longer = F.struct(cur["anchor"].alias("anchor"), cur["started"].alias("started"), r["ended"].alias("ended"), (cur["n"] + r["n"]).alias("n"))
        fresh = F.struct(r["value"].cast("int").alias("anchor"), r["started"].alias("started"), r["ended"].alias("ended"), r["n"].cast("bigint").alias("n"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(fresh))).cast(f"array<{RUN}>")

    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), start, step)


def _pick(tolerance: int, gap: int):
    """Folds the slots of each entity in time order. The state is one anchor, one start and one end, whatever comes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor, start, end = None, 0, 0, 0
        for b in batches:
            shifts, starts = [], []
            for e0, e1, first, first_at, last_at, anchors, last_starts, counts in zip(b.e0, b.e1, b["first"], b.first_at, b.last_at, b.anchors, b.last_starts, b.counts, strict=True):
                go_on = (e0, e1) == key and abs(first - anchor) <= tolerance and first_at - end <= gap
                shift = anchor - first if go_on else 0
                i = shift + tolerance
                shifts.append(shift)
                starts.append(start if go_on else first_at)
                if not (go_on and counts[i] == 1):
                    start = last_starts[i] if counts[i] > 1 else first_at
                key, anchor, end = (e0, e1), anchors[i], last_at
            yield pd.DataFrame({"e0": b.e0, "e1": b.e1, "slot": b.slot, "shift": shifts, "first_started": starts})

    return run


def collapse_runs(observations: DataFrame, tolerance: int = 1, max_gap_minutes: int = 60, slot_hours: int = 24) -> DataFrame:
    """``story_id, surface, started_us, ended_us, observations, duration_us, anchor``: one row per run, also of a single observation.

    All rows count: repeated ones once, and of several positions of a story on a surface at one instant the smallest.
    Rows with a null story_id, surface, observed_at or position are no observations. Extra columns are ignored. An empty
    table gives no rows. ``slot_hours`` only sets how work is spread; it doesn't change the result.
    """
    ship_package(observations.sparkSession)
    gap, slot_us = max_gap_minutes * 60_000_000, slot_hours * 3_600_000_000
    o = observations.select("story_id", "surface", F.unix_micros("observed_at").alias("us"), F.col("position").cast("int").alias("value")).where("story_id is not null and surface is not null and us is not null and value is not null")
    o = o.withColumn("slot", F.floor(F.col("us") / F.lit(slot_us))).repartition("story_id", "surface", "slot")
    points = o.groupBy("story_id", "surface", "slot", "us").agg(F.min("value").alias("value"))
    runs = exact_runs(points, ["story_id", "surface", "slot"], "us", "value", gap)
    slots = runs.groupBy("story_id", "surface", "slot").agg(F.array_sort(F.collect_list(F.struct("started", "ended", "value", "n"))).alias("runs"))
    shifts = range(-tolerance, tolerance + 1)
    slots = slots.select("story_id", "surface", "slot", F.element_at("runs", 1)["value"].alias("first"), F.array(*[_fold(F.col("runs"), s, tolerance, gap) for s in shifts]).alias("folds"))
    # Read twice below: for the fold over slots and for its choice.
    slots = written(slots)

    last = lambda f: F.transform("folds", lambda x: F.element_at(x, -1)[f])
    heads = slots.select(
        F.col("story_id").alias("e0"), F.col("surface").alias("e1"), "slot", "first",
        F.element_at(F.element_at("folds", 1), 1)["started"].alias("first_at"), F.element_at(F.element_at("folds", 1), -1)["ended"].alias("last_at"),
        last("anchor").alias("anchors"), last("started").alias("last_starts"), F.transform("folds", lambda x: F.size(x)).alias("counts"),
    )
    heads = heads.repartition("e0", "e1").sortWithinPartitions("e0", "e1", "slot")
    picked = heads.mapInPandas(_pick(tolerance, gap), "e0 string, e1 string, slot long, shift int, first_started long")
    picked = picked.select(F.col("e0").alias("story_id"), F.col("e1").alias("surface"), "slot", "shift", "first_started")
    chosen = slots.join(picked, ["story_id", "surface", "slot"]).select("story_id", "surface", "first_started", F.posexplode(F.element_at("folds", F.col("shift") + F.lit(tolerance + 1))).alias("i", "r"))
    started = F.when(F.col("i") == 0, F.col("first_started")).otherwise(F.col("r.started"))
    whole = chosen.select("story_id", "surface", started.alias("started_us"), "r.anchor", "r.ended", "r.n").groupBy("story_id", "surface", "started_us")
    # Within a run the anchor is the same in every slot.
    whole = whole.agg(F.max("ended").alias("ended_us"), F.sum("n").alias("observations"), F.min("anchor").alias("anchor"))
    return whole.select("story_id", "surface", "started_us", "ended_us", "observations", (F.col("ended_us") - F.col("started_us")).alias("duration_us"), "anchor")
