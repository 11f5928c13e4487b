"""Sources, sinks and streams on a temporary folder."""

import zipfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.sinks import tables as K
from quillspark.sources import migration, pages
from quillspark.sources import tables as S
from quillspark.streaming import ingest, rate_limit

T0 = datetime(2024, 1, 1, 10, tzinfo=timezone.utc)


def obs(spark, rows):
    return spark.createDataFrame([(T0 + timedelta(days=d), "front_page", p, t, "u", "s", f"r{d}") for d, p, t in rows], schemas.OBSERVATIONS)


def test_upsert_touches_only_its_days(spark, tmp_path):
    path = str(tmp_path / "o")
    K.upsert_days(obs(spark, [(0, 1, "a"), (1, 1, "b")]), path, schemas.KEYS["observations"], "observed_at")
    K.upsert_days(obs(spark, [(1, 1, "c"), (1, 2, "d")]), path, schemas.KEYS["observations"], "observed_at")
    K.upsert_days(obs(spark, [(1, 1, "c"), (1, 2, "d")]), path, schemas.KEYS["observations"], "observed_at")
    got = {(r["scrape_id"], r["position"], r["title"]) for r in spark.read.parquet(path).collect()}
    assert got == {("r0", 1, "a"), ("r1", 1, "c"), ("r1", 2, "d")}
    assert (tmp_path / "o" / "year=2024" / "month=01" / "day=2024-01-02").exists()


def test_stream_upserts_once(spark, tmp_path):
    src, target, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for rows in ([(0, 1, "a")], [(0, 1, "b"), (1, 1, "c")]):
        K.write_table(obs(spark, rows), src, mode="append")
        ingest.upsert_stream(ingest.read_deliveries(spark, src, "observations"), target, schemas.KEYS["observations"], "observed_at", mark).awaitTermination()
    assert {(r["scrape_id"], r["title"]) for r in spark.read.parquet(target).collect()} == {("r0", "b"), ("r1", "c")}


def test_compaction(spark, tmp_path):
    prefix = str(tmp_path / "signals")
    df = lambda rows: spark.createDataFrame(rows, "content_sha256 string, generated_at timestamp, summary string")
    paths = [K.append_shard(df(rows), prefix, "content_sha256") for rows in ([("a", T0, "old")], [("a", T0 + timedelta(1), "new"), ("b", T0, "x")])]
    assert paths[0] != paths[1]
    report = K.compact(spark, prefix, "content_sha256", "generated_at").head()
    assert (report["version"], report["rows_before"], report["rows_after"]) == (1, 3, 2)
    read = lambda: {(r["content_sha256"], r["summary"]) for r in spark.read.parquet(*K.live_paths(spark, prefix)).collect()}
    assert read() == {("a", "new"), ("b", "x")}
    with pytest.raises(RuntimeError):
        K.compact(spark, prefix, expected_version=7)
    # A shard that comes later stays beside the base; one that a stopped compaction left behind isn't read twice.
    K.append_shard(df([("c", T0, "late")]), prefix, "content_sha256")
    assert read() == {("a", "new"), ("b", "x"), ("c", "late")}
    real, K.delete = K.delete, lambda *a: None
    try:
        K.compact(spark, prefix)
    finally:
        K.delete = real
    assert sorted(read()) == [("a", "new"), ("b", "x"), ("c", "late")] and len(K.live_paths(spark, prefix)) == 1
    assert K.compact(spark, prefix, "content_sha256", "generated_at").head()["version"] == 3


def test_only_one_of_two_compactions_wins(spark, tmp_path, monkeypatch):
    prefix = str(tmp_path / "signals")
    df = spark.createDataFrame([("a", T0)], "content_sha256 string, generated_at timestamp")
    K.append_shard(df, prefix, "content_sha256")
    write = K.write_table

    def overtaken(*a, **k):
        monkeypatch.setattr(K, "write_table", write)
        K.compact(spark, prefix)
        write(*a, **k)

    monkeypatch.setattr(K, "write_table", overtaken)
    with pytest.raises((RuntimeError, Exception)):
        K.compact(spark, prefix)
    assert spark.read.parquet(*K.live_paths(spark, prefix)).count() == 1


def test_pauses():
    assert K.pause_for(OSError("disk")) == 5.0
    assert K.pause_for(OSError("HTTP 429 too many requests"), 1.0) == 60.0
    assert K.pause_for(OSError("429: commits are limited")) == 3600.0


def test_publication_of_captures(spark, tmp_path):
    runs = K.typed([{"scrape_id": "r0", "started_at": T0, "completed_at": T0, "success": True, "most_read_count": 1, "front_page_count": 0, "selector_version": "v", "error": "", "workflow_run_url": "", "article_html": "no"}], "scrape_runs", spark)
    with pytest.raises(ValueError, match="no observations"):
        K.publish_captures(obs(spark, []), runs, str(tmp_path))
    assert not K.exists(spark, str(tmp_path / "scrape_runs"))
    rows = obs(spark, [(0, 1, "a"), (0, 2, "b")])
    assert K.publish_captures(rows, runs, str(tmp_path)) == {"observations": 2, "scrape_runs": 1}
    assert K.publish_captures(rows, runs, str(tmp_path)) == {"observations": 2, "scrape_runs": 1}


def test_shards_are_tried_again(spark, tmp_path, monkeypatch):
    calls, waits = [], []

    def flaky(df, path, mode="x", partition_by=None):
        calls.append(path)
        if len(calls) == 1:
            raise OSError("busy")

    monkeypatch.setattr(K, "write_table", flaky)
    K.append_shard(obs(spark, [(0, 1, "a")]), str(tmp_path), "story_id", wait=waits.append, delay=3600)
    assert len(calls) == 2 and waits == [3600]


def test_readers(spark, tmp_path):
    K.write_table(obs(spark, [(0, 1, "a")]).drop("url"), str(tmp_path / "observations.parquet"))
    t = S.load_tables(spark, str(tmp_path))
    assert t["observations"].head()["url"] is None and t["story_signals"].count() == 0
    assert t["story_signals"].schema.names == schemas.STORY_SIGNALS.names
    with pytest.raises(FileNotFoundError):
        S.read_prefix(spark, str(tmp_path), "scrape_runs", required=True)
    K.save_as_table(t["observations"], "kept_observations", "it's kept")
    assert S.catalog_counts(spark, ["kept_observations"]).head()["rows"] == 1
    with pytest.raises(ValueError, match="nowhere"):
        S.catalog_counts(spark, ["nowhere"])
    spark.sql("DROP TABLE kept_observations")


def test_html_goes_apart(spark):
    df = spark.createDataFrame([("s", "u", T0, "<p>", "h", "t")], "snapshot_id string, canonical_url string, fetched_at timestamp, article_html string, html_sha256 string, title string")
    public, raw = K.split_articles(df)
    assert "article_html" not in public.columns and raw.head()["article_html"] == "<p>"


def test_migration(spark, tmp_path):
    head = "﻿timestamp,rank,title,link\n"
    (tmp_path / "most_read.csv").write_text(head + "2024-01-01 10:00:00 UTC,3,A,https://p.example/a/?x\n2024-01-01 10:00:00 UTC,,B,/b\n")
    with zipfile.ZipFile(tmp_path / "old.zip", "w") as z:
        z.writestr("front.csv", "timestamp,title,link\n2024-01-02 10:00:00 UTC,C,/c\nbad,D,/d\n")
    rows = migration.legacy_rows(spark, str(tmp_path))
    o = migration.legacy_observations(rows, F.when(F.col("source").contains("most_read"), "most_read").otherwise("front_page"), "https://p.example")
    got = sorted((r["surface"], r["position"], r["title"], r["url"]) for r in o.collect())
    assert got == [("front_page", 1, "C", "https://p.example/c"), ("most_read", 2, "B", "https://p.example/b"), ("most_read", 3, "A", "https://p.example/a")]
    assert {r["rows"] for r in migration.source_counts(rows).collect()} == {2}
    art = spark.createDataFrame([("https://p.example/a", "https://p.example/a", "T", ["x"], "<p>", "body", True)], "url string, first_appeared_at string, title string, authors array<string>, article_html string, article_text string, fetch_ok boolean")
    first = o.groupBy("url").agg(F.min("observed_at").alias("first_observed_at"))
    a = migration.legacy_articles(art, F.lit("2024-01-05").cast("date"), first, "https://p.example").head()
    assert a["first_observed_at"] == datetime(2024, 1, 1, 10) and a["fetched_at"] == datetime(2024, 1, 6, 2)


HOME = """<div data-component="mostRead"><ol><li><a href="/a">A</a></li><li>ad</li><li><a href="/b">B</a></li></ol></div>
<section data-component="top-stories"><ul><li><a href="/a"><span class="x-PromoHeadline">A</span> more</a></li><li><a href="/a">A</a></li><li><a href="/c">C</a></li></ul></section>"""


def test_home_pages(spark):
    df = spark.createDataFrame([("1", HOME), ("2", "<ol><li><a href='/x'>x</a></li></ol>"), ("3", None)], "id string, html string")
    got = sorted((r["id"], r["surface"], r["position"], r["title"], r["error"]) for r in pages.parse_homepages(df, "id", "html").where("id = '1'").collect())
    assert got == [("1", "front_page", 1, "A", None), ("1", "front_page", 2, "C", None), ("1", "most_read", 1, "A", None), ("1", "most_read", 3, "B", None)]
    assert {r["error"] for r in pages.parse_homepages(df, "id", "html").where("id <> '1'").collect()} == {"no front_page list"}


def test_article_pages():
    page = '<link rel="canonical" href=" /x "><meta property="og:title" content="T"><meta name="byl" content="Ann"><h1>H</h1><a rel="author">Bob</a><div data-component="text-block">one <b>two</b></div><div data-component="text-block">three</div>'
    canonical, title, authors, markup, body = pages.read_article(page)
    assert (canonical, title, authors, body) == ("/x", "T", ["Ann", "Bob"], "one two three")
    assert 'data-component="text-block"' in markup and "one" in markup
    assert pages.read_article("<h1>H</h1><main><p>x &lt; y</p></main>") == (None, "H", [], "<main><p>x &lt; y</p></main>", "x < y")
    assert pages.read_article("<main><p>x</p><script>no</script></main>")[4] == "x"
    assert pages.read_article("")[4] == ""
    grid = '<div class="ssrcss-1euvvif-Wrap"><ul><li><a href="/no">No</a></li></ul><ul class="a-Grid"><li><a href="/g">Grid</a></li></ul></div>'
    assert pages.top_stories(pages.tree(grid)) == [(1, "Grid", "/g")]


def test_fetching_keeps_failures(spark):
    def get(url):
        if "bad" in url:
            raise OSError("down")
        return 200, "<p>ok</p>"

    df = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "url string")
    got = {r["url"]: (r["status"], r["error"]) for r in pages.fetch_pages(df, "url", get, per_second=1000).collect()}
    assert got == {"a": (200, None), "bad": (None, "down")}


def test_rate_limit(spark):
    rows = [("c", T0 + timedelta(seconds=100 * i), i) for i in range(9)] + [("d", T0, 99), (None, T0, 1)]
    df = spark.createDataFrame(rows, "client string, at timestamp, n long")
    got = {r["n"]: r["admitted"] for r in rate_limit.admit_batch(df, "client", "at", "n").collect()}
    assert [got[i] for i in range(9)] == [True] * 5 + [False, True, True, True] and got[99]


def test_checkpoint_survives_and_clears_failures(spark, tmp_path):
    from quillspark.operators.checkpoint import Checkpoint

    c = Checkpoint(spark, str(tmp_path / "cp"))
    assert c.failures().count() == 0
    c.record_failures(spark.createDataFrame([("a", "x" * 3000), ("b", "down")], "content_sha256 string, error string"))
    c.record(spark.createDataFrame([("a", 1)], "content_sha256 string, n int"))
    c.record(spark.createDataFrame([("a", 2), ("c", 3)], "content_sha256 string, n int"))
    again = Checkpoint(spark, str(tmp_path / "cp"))
    assert {tuple(r) for r in again.results("content_sha256 string, n int").collect()} == {("a", 2), ("c", 3)}
    assert {r["content_sha256"] for r in again.failures().collect()} == {"b"}


def test_one_day(spark, tmp_path):
    path = str(tmp_path / "o")
    K.upsert_days(obs(spark, [(0, 1, "a"), (1, 1, "b")]), path, schemas.KEYS["observations"], "observed_at")
    assert [r["title"] for r in S.read_day(spark, path, "observations", "2024-01-02").collect()] == ["b"]
    assert S.read_day(spark, path, "observations", "2025-01-02").count() == 0
    assert S.read_day(spark, str(tmp_path / "none"), "observations", "2025-01-02").count() == 0
