from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.operators import enrichment, event_clusters, latest, search
from quillspark.plans import marts, sqltools

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_latest_is_planned_with_a_group_limit(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    got = latest.latest_by(df, ["k"], [F.col("t").desc()])
    assert {(r["k"], r["v"]) for r in got.collect()} == {("a", "y"), ("b", "z")}
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["k"], r["v"]) for r in latest.latest_values(df, ["k"], ["t"], ["v"]).collect()} == {("a", "y"), ("b", "z")}


def test_merge_unique(spark):
    old = spark.createDataFrame([("10", "old"), ("2", "old")], "k string, v string")
    new = spark.createDataFrame([("2", "new", 1), ("3", "a", 1), ("3", "b", 2)], "k string, v string, n int")
    got = [tuple(r) for r in latest.merge_unique(old, new, ["k"], ["n"]).collect()]
    assert got == [("10", "old", None), ("2", "new", 1), ("3", "b", 2)]
    again = latest.merge_unique(new, new, ["k"], ["n"]).collect()
    assert [r["v"] for r in again] == ["new", "b"]


def test_not_done_and_keys(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    done, failed = spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("b",)], "k string")
    assert {r[0] for r in latest.not_done(c, done, "k", failed).collect()} == {"c"}
    assert {r[0] for r in latest.not_done(c, done, "k", failed, retry_failures=True).collect()} == {"b", "c"}
    assert {tuple(r) for r in latest.same_keys(c, done, "k").collect()} == {("b", "left"), ("c", "left")}


def test_shards(spark):
    df = spark.range(300).withColumnRenamed("id", "n")
    got = enrichment.assign_shards(df, ["n"]).groupBy("shard").count().collect()
    assert [(r["shard"], r["count"]) for r in got] == [(0, 256)]
    forced = {r["shard"]: r["count"] for r in enrichment.assign_shards(df, ["n"], force=True).groupBy("shard").count().collect()}
    assert forced == {0: 256, 1: 44}


def test_usage_sums_and_prefix(spark):
    rows = spark.createDataFrame([("r", "b", 11), ("r", "a", 11), ("s", "c", 5)], "response string, k string, total long")
    got = {(r["response"], r["k"]): r["row_total"] for r in enrichment.allocate_usage(rows, "response", ["k"], ["total"]).collect()}
    assert got == {("r", "a"): 6, ("r", "b"): 5, ("s", "c"): 5}
    spend = spark.createDataFrame([("a", 0.002), ("a", 0.002), ("b", 0.002)], "k string, c double")
    assert float(enrichment.distinct_sum(spend, ["k"], "c").head()["total"]) == pytest.approx(0.004)
    df = spark.createDataFrame([(i, 10) for i in range(50)], "i int, c int")
    assert sorted(r["i"] for r in enrichment.affordable_prefix(df, "c", ["i"], 95).collect()) == list(range(9))


def test_embedding_models_are_injected(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, t string")
    got = {r["k"]: r["embedding"] for r in enrichment.embed(df, "t", lambda: lambda texts: [[3.0, 4.0] for _ in texts], 2).collect()}
    assert got["a"] == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="2 numbers are needed"):
        enrichment.embed(df, "t", lambda: lambda texts: [[0.0, 0.0] for _ in texts], 2).collect()

    def boom():
        raise AssertionError("the model isn't needed without rows")

    assert enrichment.embed(df.where("false"), "t", boom, 2).count() == 0
    got = enrichment.label(df, "k", "t", lambda: lambda rows: (_ for _ in ()).throw(ValueError("down"))).collect()
    assert {r["error"] for r in got} == {"down"}


def _articles(spark, rows):
    base = {"requested_url": "", "canonical_url": "u", "first_observed_at": T0, "fetched_at_is_inferred": False, "title": "t", "authors": [], "article_text": "x", "html_sha256": "", "http_status": 200, "fetch_ok": True}
    return spark.createDataFrame([base | r for r in rows], schemas.ARTICLE_SNAPSHOTS)


def _signals(spark, rows):
    base = {"model": "m", "prompt_version": "v", "topic": "politics", "themes": ["a"], "summary": "s", "story_form": "report", "generated_at": T0, "deepseek_response_id": "r", "prompt_tokens": 1, "prompt_cache_hit_tokens": 0, "prompt_cache_miss_tokens": 1, "completion_tokens": 1, "request_cost_usd": 0.0, "batch_size": 1}
    return spark.createDataFrame([base | r for r in rows], schemas.STORY_SIGNALS)


def _vectors(spark, rows):
    return spark.createDataFrame([(k, "m", "r", "i", [float(x) for x in v], T0) for k, v in rows], schemas.ARTICLE_EMBEDDINGS)


def _clusters(spark, vectors, stories="abc", types="eee"):
    a = _articles(spark, [{"snapshot_id": f"s{i}", "story_id": s, "content_sha256": f"h{i}", "fetched_at": T0 + timedelta(days=i)} for i, s in enumerate(stories)])
    s = _signals(spark, [{"content_sha256": f"h{i}", "event_label": "harbour strike vote", "event_type": t, "named_entities": ["Ann"]} for i, t in enumerate(types)])
    out = event_clusters.cluster_events(a, s, _vectors(spark, [(f"h{i}", v) for i, v in enumerate(vectors)]))
    return {r["content_sha256"]: (r["cluster_id"], r["cluster_size"]) for r in out.collect()}


def test_clusters_compare_with_the_anchor_only(spark):
    got = _clusters(spark, [(1, 0), (0.9, 0.43589), (0.62, 0.7846)])
    assert [got[f"h{i}"][1] for i in range(3)] == [2, 2, 1]
    assert got["h0"][0] == got["h1"][0] != got["h2"][0]


def test_later_versions_follow_their_story(spark):
    got = _clusters(spark, [(1, 0), (0, 1), (0, 1)], stories="aab", types="exe")
    assert got["h0"] == got["h1"] and got["h2"][1] == 1


def test_search(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [-1.0, 0.0]), ("d", [0.0, 0.0]), ("e", [1.0])], "story_id string, embedding array<float>")
    got = search.vector_search(df, [1.0, 0.0], k=5)
    assert [(r["story_id"], round(r["score"], 4)) for r in got.collect()] == [("a", 1.0), ("b", 0.7071)]
    assert "TakeOrderedAndProject" in got._jdf.queryExecution().executedPlan().toString()
    assert [r["story_id"] for r in search.related(df, "a", [1.0, 0.0]).collect()] == ["b", "c"]


def test_marts_of_two_observations(spark):
    rows = [(T0 + timedelta(hours=10), "front_page", 1, "t", "u", "s", "r1"), (T0 + timedelta(hours=12), "most_read", 3, "t2", "u", "s", "r2")]
    o = spark.createDataFrame(rows, schemas.OBSERVATIONS)
    empty = {n: spark.createDataFrame([], schemas.TABLES[n]) for n in ("article_snapshots", "story_signals", "article_embeddings", "recurring_events")}
    out = marts.build_marts(o, *empty.values())
    s = out["stories"].head()
    assert (s["title"], s["observation_count"], s["best_position"], s["surfaces"]) == ("t2", 2, 1, ["front_page", "most_read"])
    assert out["lag"].head()["lag_minutes"] == 120
    assert out["coverage"].head()["coverage_percent"] == 0.0
    assert tuple(out["findings_window"].head()) == (0, None, None, None, None)
    alone = marts.build_marts(o)
    assert alone["stories"].head() == s and alone["semantic_index"].count() == alone["recurring"].count() == 0
    counts = {r["name"]: r["rows"] for r in out["manifest"].collect()}
    assert counts["stories"] == 1 and counts["rank_series"] == 2 and counts["trends"] == 0 and counts["rising_themes"] == 0


def test_index_of_one_vector(spark):
    a = _articles(spark, [{"snapshot_id": "s", "story_id": "st", "content_sha256": "h", "fetched_at": T0}])
    v = np.zeros(384)
    v[:2] = 0.6, 0.8
    o = spark.createDataFrame([], schemas.OBSERVATIONS)
    ix = marts.semantic_index(a, _signals(spark, [{"content_sha256": "h", "event_label": "l", "event_type": "e", "named_entities": []}]), _vectors(spark, [("h", v)]), marts.story_stats(o))
    from quillspark.sinks.tables import vector_blob

    assert len(vector_blob(ix)) == 384
    assert ix.head()["vector"][:2] == [95, 127] and ix.head()["observation_count"] == 0


def test_returning_order(spark):
    base = {"cluster_label": "l", "canonical_url": "u", "title": "t", "topic": "x", "themes": ["a"], "event_label": "e", "event_type": "k", "named_entities": [], "similarity_to_anchor": 1.0}
    rows = [base | {"cluster_id": "new", "cluster_size": 2, "content_sha256": f"n{i}", "story_id": f"n{i}", "fetched_at": T0 + timedelta(days=100)} for i in range(2)]
    rows += [base | {"cluster_id": "old", "cluster_size": 8, "content_sha256": f"o{i}", "story_id": f"o{i}", "fetched_at": T0} for i in range(8)]
    rec = marts.recurring_stories(spark.createDataFrame(rows, schemas.RECURRING_EVENTS), marts.story_stats(spark.createDataFrame([], schemas.OBSERVATIONS)))
    assert [r["cluster_id"] for r in marts.returning_stories(rec).collect()] == ["old", "new"]
    assert marts.event_page(rec, page=9).count() == 2


def test_sql_is_read_only(spark):
    t = {"t": spark.range(500).withColumnRenamed("id", "n")}
    assert sqltools.run_sql(spark, t, "select n from t where n > 3 -- drop").count() == 200
    for bad in ("drop table t", "select 1; select 2", "insert into t values (1)", "with x as (select 1) delete from t"):
        with pytest.raises(ValueError):
            sqltools.run_sql(spark, t, bad)
    assert sqltools.run_sql(spark, t, "select 'drop table' as x").head()[0] == "drop table"
    assert sqltools.profile(t["t"]).head()["rows"] == 500


def test_labelling_is_tried_again_in_several_threads(spark):
    df = spark.createDataFrame([(f"k{i}", "t") for i in range(20)], "k string, t string").coalesce(1)

    def client():
        calls = {}

        def ask(rows):
            n = calls[rows[0][0]] = calls.get(rows[0][0], 0) + 1
            if n == 1:
                raise ValueError("busy")
            return ",".join(k for k, _ in rows)

        return ask

    got = enrichment.label(df, "k", "t", client).collect()
    assert len(got) == 20 and all(r["error"] is None and r["k"] in r["response"].split(",") for r in got)


def test_search_falls_back_on_keywords(spark):
    rows = [("a", "harbour vote", "s", "t", ["x"], [1.0, 0.0]), ("b", "budget", "s", "t", ["x"], [0.0, 1.0])]
    index = spark.createDataFrame(rows, "story_id string, title string, summary string, topic string, themes array<string>, embedding array<float>")
    seen = []

    def embed(q):
        seen.append(q)
        return [0.0, 2.0]

    ids = lambda df: [r["story_id"] for r in df.collect()]
    assert ids(search.search(index, "harbour", embed, prefix="query: ")) == ["b"] and seen == ["query: harbour"]
    assert ids(search.search(index, "harbour")) == ["a"]
    assert ids(search.search(index, "harbour", lambda q: 1 / 0)) == ["a"]


def test_stated_queries_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((60, 4)), 1)
    x[5], x[6] = x[7], 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0])], "id long, embedding array<float>")
    u = x.astype(np.float32).astype(float) / np.maximum(np.linalg.norm(x.astype(np.float32).astype(float), axis=1, keepdims=True), 1e-9)
    want = {(i, j) for i in range(0, 60, 5) for j in sorted((j for j in range(60) if j not in (i, 6)), key=lambda j: (-round(float(u[i] @ u[j]), 12), j))[:3]}
    for block in (4, 1000):
        got = search.nearest_to_queries(df.withColumn("score", F.lit("x")).repartition(5), df.where("id % 5 = 0 and id < 60"), "id", 3, block=block)
        assert {(r["query_id"], r["id"]) for r in got.collect()} == want
    assert search.nearest_to_queries(df, df.where("false"), "id").count() == 0


def test_admission_of_a_stream(spark, tmp_path):
    from quillspark.streaming.rate_limit import admit_batch, admit_stream

    rows = [(c, T0 + timedelta(seconds=s)) for c in "ab" for s in (0, 10, 20, 30, 40, 50, 60, 700, 705)]
    df = spark.createDataFrame(rows, "client string, at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for marked in (False, True):
        s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        out = admit_stream(s.withWatermark("at", "1 minute") if marked else s, "client", "at")
        name = f"admitted_{marked}".lower()
        out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        got = sorted(map(tuple, spark.table(name).select("client", "at", "admitted").collect()))
        want = sorted(map(tuple, admit_batch(df, "client", "at", "at").collect()))
        assert got == want
