"""Declared schemas of the stored tables. All timestamps are UTC."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1


def _s(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else False) for f in fields])


_STR, _TS, _LIST = T.StringType(), T.TimestampType(), T.ArrayType(T.StringType(), True)

OBSERVATIONS = _s(("observed_at", _TS), ("surface", _STR), ("position", T.ByteType()), ("title", _STR), ("url", _STR), ("story_id", _STR), ("scrape_id", _STR))
SCRAPE_RUNS = _s(
    ("scrape_id", _STR), ("started_at", _TS), ("completed_at", _TS), ("success", T.BooleanType()), ("http_status", T.ShortType(), True), ("most_read_count", T.ShortType()),
    ("front_page_count", T.ShortType()), ("selector_version", _STR), ("error", _STR), ("workflow_run_url", _STR),
)
ARTICLE_SNAPSHOTS = _s(
    ("snapshot_id", _STR), ("requested_url", _STR), ("canonical_url", _STR), ("story_id", _STR), ("first_observed_at", _TS), ("fetched_at", _TS), ("fetched_at_is_inferred", T.BooleanType()),
    ("title", _STR), ("authors", _LIST), ("article_text", _STR), ("content_sha256", _STR), ("html_sha256", _STR), ("http_status", T.ShortType(), True), ("fetch_ok", T.BooleanType()),
)
RAW_ARTICLE_SNAPSHOTS = _s(("snapshot_id", _STR), ("canonical_url", _STR), ("fetched_at", _TS), ("article_html", _STR), ("html_sha256", _STR))
STORY_SIGNALS = _s(
    ("content_sha256", _STR), ("model", _STR), ("prompt_version", _STR), ("topic", _STR), ("themes", _LIST), ("summary", _STR), ("named_entities", _LIST), ("event_label", _STR), ("event_type", _STR),
    ("story_form", _STR), ("generated_at", _TS), ("deepseek_response_id", _STR), ("prompt_tokens", T.LongType()), ("prompt_cache_hit_tokens", T.LongType()), ("prompt_cache_miss_tokens", T.LongType()),
    ("completion_tokens", T.LongType()), ("request_cost_usd", T.DoubleType()), ("batch_size", T.ShortType()),
)
ARTICLE_EMBEDDINGS = _s(("content_sha256", _STR), ("model", _STR), ("model_revision", _STR), ("input_version", _STR), ("embedding", T.ArrayType(T.FloatType(), True)), ("generated_at", _TS))
RECURRING_EVENTS = _s(
    ("cluster_id", _STR), ("cluster_label", _STR), ("cluster_size", T.IntegerType()), ("content_sha256", _STR), ("story_id", _STR), ("canonical_url", _STR), ("title", _STR), ("fetched_at", _TS),
    ("topic", _STR), ("themes", _LIST), ("event_label", _STR), ("event_type", _STR), ("named_entities", _LIST), ("similarity_to_anchor", T.FloatType()),
)

TABLES = {
    "observations": OBSERVATIONS,
    "scrape_runs": SCRAPE_RUNS,
    "article_snapshots": ARTICLE_SNAPSHOTS,
    "raw_article_snapshots": RAW_ARTICLE_SNAPSHOTS,
    "story_signals": STORY_SIGNALS,
    "article_embeddings": ARTICLE_EMBEDDINGS,
    "recurring_events": RECURRING_EVENTS,
}
#: Keys that upserts and repairs merge by.
KEYS = {"observations": ["scrape_id", "surface", "position"], "scrape_runs": ["scrape_id"], "article_snapshots": ["snapshot_id"], "raw_article_snapshots": ["snapshot_id"]}
