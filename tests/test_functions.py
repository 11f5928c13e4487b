from datetime import datetime, timezone
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import ids, jsontext, numbers, text, times, vector


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in ((k, _type(v)) for k, v in values.items()))) if values else spark.range(1)
    return df.select(column.alias("x")).head()[0]


def _type(v):
    return {str: "string", int: "long", float: "double", list: "array<string>", datetime: "timestamp", type(None): "string"}[type(v)]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://WWW.Paper.example/News/a-1/?x=1#top", "https://www.paper.example/News/a-1"),
        (" https://paper.example ", "https://paper.example/"),
        ("/news/a", "https://paper.example/news/a"),
        ("//Other.example/x//", "https://other.example/x"),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, ids.normalize_url(F.col("u"), "https://paper.example"), u=url) == want


def test_stable_id_and_domains(spark):
    assert one(spark, ids.stable_id(F.col("a"), F.lit(None)), a="x") == hashlib.sha256(b"x\x1fNone").hexdigest()[:32]
    allowed = lambda u: one(spark, ids.domain_allowed(F.col("u"), ["paper.example"]), u=u)
    assert allowed("https://news.paper.example/x") and allowed("http://PAPER.example")
    assert not allowed("https://notpaper.example/x") and not allowed("ftp://paper.example") and not allowed("paper.example")


def test_text(spark):
    assert one(spark, text.collapse_space(F.col("a")), a="  a \n b ") == "a b"
    assert one(spark, text.embedding_text(F.col("t"), F.col("b")), t="Head", b="Head: - body  text") == "Head\n\nbody text"
    assert len(one(spark, text.truncate_utf8(F.col("a"), 5), a="ééé").encode()) == 4
    assert one(spark, text.label_tokens(F.col("a")), a="Flood flood-2, x") == ["flood", "2", "x"]
    assert one(spark, text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array(F.lit("b")))) == 0
    assert one(spark, text.event_entities(F.col("a")), a=[" UK", "Ann ", "ann", "", None]) == ["ann"]
    assert one(spark, text.topic(F.col("a")), a=" Weather") == "science_and_environment"
    assert one(spark, text.topic(F.col("a")), a="gossip") is None
    assert one(spark, text.lexical_score(F.lit("Harbour row"), F.lit("harbour row and budget"), ["harbour", "budget"])) == pytest.approx((2 + 1.5) / 5)
    assert one(spark, text.citation_numbers(F.lit("a [3] b [1][3] [99] [0]"), F.lit(5))) == [1, 3]
    assert one(spark, text.split_authors(F.lit("B; A;; B "))) == ["A", "B"]
    assert one(spark, text.escape_html(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#39;b&#39;&gt;"


def test_minutes_count_boundaries(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, times.minute_boundaries(t("2024-01-01 10:00:59"), t("2024-01-01 10:01:01"))) == 1
    assert one(spark, times.minute_boundaries(t("2024-01-01 10:05:00"), t("2024-01-01 10:00:01"))) == -5
    assert one(spark, times.iso(t("2024-01-01 10:00:00"))) == "2024-01-01T10:00:00+00:00"
    assert one(spark, times.iso(t("2024-01-01 10:00:00.000120"))) == "2024-01-01T10:00:00.000120+00:00"
    assert one(spark, times.from_utc_text(F.lit("2024-01-01 10:00:00 UTC"))).hour == 10
    assert one(spark, times.from_utc_text(F.lit("nonsense"))) is None
    assert one(spark, times.inferred_fetch(F.lit("2024-01-31").cast("date"))) == datetime(2024, 2, 1, 2)
    assert one(spark, times.freshness(t("2024-01-01 10:00:00"), t("2024-01-01 12:59:59"))) == "Current"


def test_vectors(spark):
    v = F.array(*[F.lit(x) for x in (3.0, 4.0, 0.0)])
    assert one(spark, vector.normalized(v, 3)) == pytest.approx([0.6, 0.8, 0.0])
    assert one(spark, vector.normalized(v, 4)) is None
    assert one(spark, vector.normalized(F.array(F.lit(0.0)))) is None
    q = one(spark, vector.quantized(F.array(*[F.lit(x) for x in (1.0, -0.5, 0.25)])))
    assert q["q"] == [127, -64, 32] and q["scale"] == pytest.approx(1 / 127)
    assert one(spark, vector.quantized(F.array(F.lit(0.0))))["scale"] == 1.0


def test_numbers(spark):
    assert [one(spark, numbers.split_evenly(F.lit(11), F.lit(4), F.lit(i))) for i in range(4)] == [3, 3, 3, 2]
    assert one(spark, numbers.percent(F.lit(1), F.lit(0))) == 0
    assert one(spark, numbers.clamp_similarity(F.lit("3.5"))) == 1.0
    assert one(spark, numbers.clamp_similarity(F.lit("x"))) == 0.0


def test_signals_and_batches(spark):
    good = {"id": "a", "topic": "Crime ", "themes": [" x ", ""], "summary": "s", "named_entities": [], "event_label": "l"}
    p = one(spark, jsontext.parse_signals(F.col("j")), j=json.dumps(good))
    assert (p["topic"], p["themes"], p["event_type"], p["error"]) == ("other", ["x"], "other", None)
    assert one(spark, jsontext.parse_signals(F.col("j")), j="{")["error"] is not None
    assert one(spark, jsontext.parse_signals(F.col("j")), j=json.dumps(good | {"themes": []}))["error"] == "no themes"
    rows = [("1", json.dumps({"articles": [good | {"id": "b"}, good]}), ["a", "b"]), ("2", json.dumps({"articles": [good]}), ["a", "b"]), ("3", json.dumps({"articles": [good, good]}), ["a", "a"]), ("4", "no", ["a"])]
    got = [(r["batch_id"], r["id"]) for r in jsontext.parse_signal_batches(spark.createDataFrame(rows, "batch_id string, content string, expected array<string>")).orderBy("batch_id", "place").collect()]
    assert got == [("1", "a"), ("1", "b")]


def test_usage(spark):
    u = one(spark, jsontext.parse_usage(F.col("j")), j='{"prompt_tokens": 1000, "prompt_tokens_details": {"cached_tokens": 750}, "completion_tokens": 100}')
    assert tuple(u) == (1000, 750, 250, 100)
    assert tuple(one(spark, jsontext.parse_usage(F.col("j")), j="{}")) == (0, 0, 0, 0)


def test_evidence(spark):
    ev = [{"url": f"https://paper.example/{i}", "title": f"t{i}"} for i in range(25)]
    ev[1], ev[2] = {"url": "https://paper.example/0", "title": "again"}, {"url": "https://evil.example/", "title": "x"}
    rows = [("r", json.dumps({"query": "what now", "evidence": ev})), ("short", json.dumps({"query": "x", "evidence": ev}))]
    got = jsontext.normalize_evidence(spark.createDataFrame(rows, "request_id string, body string"), ["paper.example"]).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 19)) and {r["request_id"] for r in got} == {"r"}


def test_answer(spark):
    a = {"answer": "yes", "findings": [{"claim": "c", "sources": [1, 99, 1]}, {"claim": "d", "sources": [99]}], "limitations": "l"}
    p = one(spark, jsontext.parse_answer(F.col("j"), F.lit(1)), j=json.dumps(a))
    assert [(f["claim"], f["sources"]) for f in p["findings"]] == [("c", [1])] and p["error"] is None
    assert one(spark, jsontext.parse_answer(F.col("j"), F.lit(1)), j="{}")["error"] == "no answer"


def test_cut_bytes_at_every_length(spark):
    t = "aé漢😀b😀é"
    for n in range(0, 20):
        got = one(spark, text.truncate_utf8(F.col("a"), n), a=t)
        assert got == t.encode()[:n].decode(errors="ignore")


def test_casefold(spark):
    for t in ("STRASSE", "straße", "ΣΑΣ", "σας", "ﬁne", "Äpfel", "ſo"):
        assert one(spark, text.casefold(F.col("a")), a=t) == t.casefold()


def test_months_and_default_day(spark):
    now = F.lit("2024-03-01 00:30:00").cast("timestamp")
    assert one(spark, times.this_month(F.col("a").cast("timestamp"), now), a="2024-02-29 23:59:59") is False
    assert str(one(spark, times.default_day(now), a="")) == "2024-02-29"
