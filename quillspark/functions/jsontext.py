"""JSON of labels, usage, evidence and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.ids import domain_allowed
from quillspark.functions.numbers import clamp_similarity
from quillspark.functions.text import collapse_space, or_other, string_list, topic

SIGNALS = "struct<id:string,topic:string,themes:array<string>,summary:string,named_entities:array<string>,event_label:string,event_type:string,story_form:string>"
USAGE = "struct<prompt_tokens:bigint,prompt_cache_hit_tokens:bigint,prompt_cache_miss_tokens:bigint,completion_tokens:bigint,prompt_tokens_details:struct<cached_tokens:bigint>>"
EVIDENCE = "struct<query:string,reasoning:string,evidence:array<struct<url:string,title:string,date:string,summary:string,topic:string,themes:array<string>,story_form:string,event_type:string,similarity:string>>>"
ANSWER = "struct<answer:string,findings:array<struct<claim:string,sources:array<string>>>,limitations:string>"


def checked_signals(s: Column) -> Column:
    """Label fields cleaned, and ``error`` where a required one is missing or the topic is unknown."""
    themes, names = string_list(s["themes"], 5), F.coalesce(string_list(s["named_entities"], 8), F.array().cast("array<string>"))
    t, summary, label = topic(s["topic"]), F.trim(s["summary"]), F.trim(s["event_label"])
    error = (
        F.when(s.isNull(), "not a JSON object")
        .when(t.isNull(), "unsupported topic")
        .when(F.coalesce(summary, F.lit("")).eqNullSafe("") | F.coalesce(label, F.lit("")).eqNullSafe(""), "no summary or event_label")
        .when(themes.isNull(), "themes is no array")
        .when(F.size(themes) == 0, "no themes")
    )
    return F.struct(t.alias("topic"), themes.alias("themes"), summary.alias("summary"), names.alias("named_entities"), label.alias("event_label"), or_other(s["event_type"]).alias("event_type"), or_other(s["story_form"]).alias("story_form"), error.alias("error"))


def parse_signals(text: Column) -> Column:
    return checked_signals(F.from_json(text, SIGNALS))


def parse_signal_batches(batches: DataFrame) -> DataFrame:
    """``batch_id, place, id, signals``: articles of each batch in the order asked for. ``batches`` has ``batch_id, content, expected`` (array of ids).

    A batch with an id missing, repeated or not asked for, or with a bad article, is rejected as a whole.
    """
    rows = F.from_json("content", f"struct<articles:array<{SIGNALS}>>")["articles"]
    b = batches.select("batch_id", "expected", rows.alias("rows"))
    ids = F.transform("rows", lambda r: r["id"])
    same = (F.size("rows") == F.size("expected")) & (F.size(F.array_distinct(ids)) == F.size("rows")) & (F.array_sort(ids) == F.array_sort("expected"))
    checked = F.transform("rows", lambda r: F.struct(r["id"].alias("id"), checked_signals(r).alias("s")))
    good = b.where(F.coalesce(same, F.lit(False))).withColumn("checked", checked).where(~F.exists("checked", lambda r: r["s"]["error"].isNotNull()))
    each = good.select("batch_id", "checked", F.posexplode("expected").alias("place", "id"))
    return each.select("batch_id", "place", "id", F.filter("checked", lambda r: r["id"] == F.col("id"))[0]["s"].alias("signals"))


def parse_usage(text: Column) -> Column:
    """Token counts with their fallbacks: hits from the details, misses as what isn't a hit."""
    u = F.from_json(text, USAGE)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    prompt = zero(u["prompt_tokens"])
    hit = F.coalesce(u["prompt_cache_hit_tokens"], u["prompt_tokens_details"]["cached_tokens"], F.lit(0).cast("bigint"))
    miss = F.coalesce(u["prompt_cache_miss_tokens"], F.greatest(F.lit(0).cast("bigint"), prompt - hit))
    return F.struct(prompt.alias("prompt_tokens"), hit.alias("cache_hit_tokens"), miss.alias("cache_miss_tokens"), zero(u["completion_tokens"]).alias("completion_tokens"))


def compact(value: Column, size: int) -> Column:
    return F.substring(F.coalesce(collapse_space(value), F.lit("")), 1, size)


def normalize_evidence(requests: DataFrame, domains: list[str], most: int = 20) -> DataFrame:
    """``request_id, query, id, url, title, date, summary, topic, themes, story_form, event_type, similarity``: usable evidence of each request, numbered from 1.

    Only the first ``most`` rows are looked at; of them those with a title and an allowed URL that no earlier one has.
    ``requests`` has ``request_id, body`` (JSON).
    """
    b = F.from_json("body", EVIDENCE)
    r = requests.select("request_id", b.alias("b")).select("request_id", compact(F.col("b.query"), 400).alias("query"), F.slice("b.evidence", 1, most).alias("rows"))
    r = r.where(F.length("query") >= 3).select("request_id", "query", F.posexplode("rows").alias("pos", "e"))
    e = lambda f, n: compact(F.col("e")[f], n).alias(f)
    themes = F.filter(F.transform(F.slice(F.coalesce(F.col("e.themes"), F.array().cast("array<string>")), 1, 5), lambda x: compact(x, 80)), lambda x: x != "")
    rows = r.select("request_id", "query", "pos", e("url", 500), e("title", 240), e("date", 40), e("summary", 900), e("topic", 80), themes.alias("themes"), e("story_form", 80), e("event_type", 80), clamp_similarity(F.col("e.similarity")).alias("similarity"))
    ok = rows.where((F.col("title") != "") & domain_allowed(F.col("url"), domains))
    first = ok.withColumn("n", F.row_number().over(Window.partitionBy("request_id", "url").orderBy("pos"))).where("n = 1")
    return first.withColumn("id", F.row_number().over(Window.partitionBy("request_id").orderBy("pos"))).drop("n", "pos")


def parse_answer(text: Column, evidence_count: Column) -> Column:
    """An answer with at most eight findings that have a claim and a valid source; ``error`` where there is no answer."""
    a = F.from_json(text, ANSWER)
    source = lambda x: x.try_cast("double")
    valid = lambda xs: F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce(xs, F.array().cast("array<string>")), lambda x: (source(x) == F.floor(source(x))) & source(x).between(1, evidence_count)), lambda x: source(x).cast("int"))))
    found = F.transform(F.slice(F.coalesce(a["findings"], F.array().cast("array<struct<claim:string,sources:array<string>>>")), 1, 8), lambda f: F.struct(compact(f["claim"], 1200).alias("claim"), valid(f["sources"]).alias("sources")))
    answer = compact(a["answer"], 6000)
    return F.struct(answer.alias("answer"), F.filter(found, lambda f: (f["claim"] != "") & (F.size(f["sources"]) > 0)).alias("findings"), compact(a["limitations"], 1500).alias("limitations"), F.when(answer == "", "no answer").alias("error"))


def request_key(*fields: Column) -> Column:
    """Digest of the canonical JSON of a request, as a cache key."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)
