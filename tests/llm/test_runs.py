"""Runs of observations against a sequential model, and hard inputs."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.llm.runs import collapse_runs

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def frame(spark, rows):
    return spark.createDataFrame(rows, "observed_at timestamp, surface string, position int, story_id string")


def model(rows, tolerance=1, gap=3600):
    best = {}
    for at, surface, position, story in rows:
        k = (story, surface, at)
        best[k] = min(position, best.get(k, position))
    out, run = [], None
    for (story, surface, at), p in sorted(best.items()):
        if run and run[0] == (story, surface) and abs(p - run[1]) <= tolerance and (at - run[3]).total_seconds() <= gap:
            run[3] = at
            run[4] += 1
        else:
            run and out.append(run)
            run = [(story, surface), p, at, at, 1]
    run and out.append(run)
    us = lambda t: round((t - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)
    return sorted((k[0], k[1], us(a), us(b), n) for k, _, a, b, n in out)


def found(df):
    return sorted(tuple(r) for r in df.select("story_id", "surface", "started_us", "ended_us", "observations").collect())


@pytest.mark.parametrize("slot_hours", [1, 24])
def test_equals_sequential_model(spark, slot_hours):
    rnd = random.Random(slot_hours)
    rows, at = [], T0
    for _ in range(900):
        at += timedelta(minutes=rnd.choice([5, 10, 10, 10, 30, 60, 61]))
        for story in ("hot", rnd.choice("abc")):
            rows.append((at, rnd.choice(["front_page", "most_read"]), rnd.randint(1, 4), story))
            if rnd.random() < 0.1:
                rows.append(rows[-1])
    assert found(collapse_runs(frame(spark, rows), slot_hours=slot_hours)) == model(rows)


def test_anchor_is_the_first_position(spark):
    rows = [(T0 + timedelta(minutes=10 * i), "s", p, "a") for i, p in enumerate([3, 4, 2, 5, 4, 6])]
    assert found(collapse_runs(frame(spark, rows))) == model(rows)
    assert [r[4] for r in found(collapse_runs(frame(spark, rows)))] == [3, 3]


def test_nulls_repeats_empty_and_extra_columns(spark):
    rows = [(T0, "s", 1, "a"), (T0, "s", 1, "a"), (T0, "s", 2, "a"), (None, "s", 1, "a"), (T0, None, 1, "a"), (T0, "s", None, "b"), (T0, "s", 1, None)]
    df = frame(spark, rows).withColumns({"us": F.lit("x"), "value": F.lit("y"), "slot": F.lit(1), "folds": F.lit(2)})
    assert [r[4] for r in found(collapse_runs(df))] == [1]
    assert collapse_runs(spark.createDataFrame([], schemas.OBSERVATIONS)).count() == 0
