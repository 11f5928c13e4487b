"""Differences of consecutive snapshots against a dictionary model."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.operators.snapshot_diff import diff_snapshots, list_changes, previous_snapshots

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
OBS = "scrape_id string, surface string, story_id string, position int, observed_at timestamp"
RUNS = "scrape_id string, started_at timestamp, completed_at timestamp, success boolean"


def model(obs, ok):
    snaps = {}
    for sid, surface, story, p, at in obs:
        if sid in ok:
            s = snaps.setdefault(sid, [at, {}])
            s[0] = min(s[0], at)
            s[1][surface, story] = min(p, s[1].get((surface, story), p))
    order = sorted((at, sid) for sid, (at, _) in snaps.items())
    out = set()
    for (a, x), (b, y) in zip(order, order[1:]):
        if (b - a).total_seconds() <= 6 * 3600:
            old, new = snaps[x][1], snaps[y][1]
            for k in old.keys() | new.keys():
                if old.get(k) != new.get(k):
                    out.add((y, *k, "added" if k not in old else "removed" if k not in new else "moved"))
    return out


def test_list_changes_equal_model(spark):
    rnd = random.Random(1)
    obs, runs, at = [], [], T0
    for i in range(120):
        at += timedelta(minutes=rnd.choice([10, 10, 10, 200, 400]))
        sid = f"r{rnd.randrange(10**6)}"
        runs.append((sid, at, at, rnd.random() < 0.85))
        if rnd.random() < 0.2:
            runs.append((sid, at, at - timedelta(hours=1), rnd.random() < 0.5))
        rows = [(sid, rnd.choice(["front_page", "most_read"]), rnd.choice("abcdef"), rnd.randint(1, 5), at) for _ in range(rnd.randint(1, 8))]
        obs += rows + rows[: rnd.randint(0, 2)]
    ok = {s for s, _, c, good in runs if good and c == max(r[2] for r in runs if r[0] == s)}
    df = spark.createDataFrame(obs, OBS).withColumns({"_later": F.lit(1), "change": F.lit("x"), "_v0": F.lit(2)})
    got = [tuple(r) for r in list_changes(df, spark.createDataFrame(runs, RUNS)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == model(obs, ok)


def test_null_keys_and_values_are_values(spark):
    rows = spark.createDataFrame([("1", "a", None), ("1", None, 1), ("1", "c", 3), ("2", "a", None), ("2", None, 2), ("2", "d", 4), ("2", "c", None)], "s string, k string, v int")
    pairs = spark.createDataFrame([("2", "1")], "s string, previous string")
    got = {(r["k"], r["change"], r["before_v"], r["after_v"]) for r in diff_snapshots(rows, pairs, "s", ["k"], ["v"]).collect()}
    assert got == {(None, "changed", 1, 2), ("c", "changed", 3, None), ("d", "added", None, 4)}


def test_empty_and_nulls(spark):
    assert list_changes(spark.createDataFrame([], schemas.OBSERVATIONS), spark.createDataFrame([], schemas.SCRAPE_RUNS)).count() == 0
    obs = spark.createDataFrame([(None, "s", "a", 1, T0), ("r", None, "a", 1, T0), ("r", "s", None, 1, T0), ("r", "s", "a", None, None)], OBS)
    runs = spark.createDataFrame([("r", T0, None, True), (None, T0, T0, True)], RUNS)
    assert list_changes(obs, runs).count() == 0


def test_no_window_over_all_snapshots(spark):
    s = spark.createDataFrame([(str(i), T0 + timedelta(hours=i)) for i in range(30)], "s string, at timestamp")
    got = {r["s"]: r["previous"] for r in previous_snapshots(s, "s", "at", 3600).collect()}
    assert got == {str(i): str(i - 1) for i in range(1, 30)}
    plan = previous_snapshots(s, "s", "at", 3600)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
