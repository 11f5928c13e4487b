"""Registered queries that go through stores, files and JSON: each writes or renders whole tables, reads them back by the library, and is checked by SQL over the tables it began with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import jsontext, numbers, text, times
from quillspark.operators import latest
from quillspark.operators.checkpoint import Checkpoint
from quillspark.plans import marts
from quillspark.plans.reference_queries import SQL as MART_SQL
from quillspark.plans.reference_queries import _covered, _index, _t
from quillspark.session import delete_at_exit, shared_dir
from quillspark.sinks import tables as sink
from quillspark.sources import migration
from quillspark.sources import tables as source
from quillspark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    return path


@query("SELECT observed_at, surface, position, title, url, story_id, scrape_id FROM observations")
def stored_layers(spark, folder):
    """A base and two shards, read as one table."""
    o, root = table(spark, folder, "observations"), _folder(spark)
    part = F.pmod(F.xxhash64(*o.columns), F.lit(4))
    sink.write_table(o.where(part < 2), f"{root}/observations/base")
    for k in (2, 3):
        sink.append_shard(o.where(part == k), f"{root}/observations", "scrape_id")
    return source.read_prefix(spark, root, "observations", required=True)


@query("SELECT 0 AS layer, count(*) AS rows FROM story_signals UNION ALL SELECT 1, count(*) FROM story_signals WHERE generated_at >= (SELECT max(generated_at) FROM story_signals) - INTERVAL 30 DAYS")
def layer_order(spark, folder):
    """The base is the first layer, a later shard the next."""
    s, root = table(spark, folder, "story_signals"), _folder(spark)
    sink.write_table(s, f"{root}/story_signals/base")
    sink.append_shard(s.where(F.col("generated_at") >= s.agg(F.max("generated_at")).scalar() - F.expr("INTERVAL 30 DAYS")), f"{root}/story_signals", "content_sha256")
    return source.read_prefix(spark, root, "story_signals", layers=True).groupBy(F.col("_layer").alias("layer")).agg(F.count("*").alias("rows"))


@query("SELECT DISTINCT observed_at, scrape_id, surface, story_id, position FROM observations WHERE CAST(observed_at AS DATE) = (SELECT max(CAST(observed_at AS DATE)) FROM observations)")
def stored_day(spark, folder):
    """One day of a table that was upserted by days, read by its partition."""
    o, path = table(spark, folder, "observations"), f"{_folder(spark)}/observations"
    keys = ["observed_at", "scrape_id", "surface", "story_id", "position"]
    sink.upsert_days(o, path, keys, "observed_at")
    day = str(o.agg(F.max(F.to_date("observed_at"))).head()[0])
    return source.read_day(spark, path, "observations", day).select(*keys)


@query("SELECT 'observations' AS name, count(*) AS rows FROM (SELECT DISTINCT scrape_id, surface, position, CAST(observed_at AS DATE) FROM observations) UNION ALL SELECT 'scrape_runs', count(DISTINCT scrape_id) FROM scrape_runs WHERE scrape_id IN (SELECT scrape_id FROM observations)")
def paired_publication(spark, folder):
    """Captures and their runs upserted together (K4)."""
    o, r = _t(spark, folder, "observations", "scrape_runs")
    runs = r.join(o.select("scrape_id").distinct(), "scrape_id", "left_semi")
    got = sink.publish_captures(o, latest.latest_by(runs, ["scrape_id"], [F.col("completed_at").desc(), F.col("started_at").desc()]), _folder(spark))
    return spark.createDataFrame(list(got.items()), "name string, rows long")


@query("SELECT content_sha256, max(generated_at) AS generated_at FROM article_embeddings WHERE content_sha256 IS NOT NULL GROUP BY 1")
def compacted_newest(spark, folder):
    """Shards compacted twice into a base, the newest row of each content."""
    e, prefix = table(spark, folder, "article_embeddings").where("content_sha256 is not null"), f"{_folder(spark)}/article_embeddings"
    part = F.pmod(F.xxhash64("content_sha256", "generated_at"), F.lit(3))
    for k in range(3):
        sink.append_shard(e.where(part == k), prefix, "content_sha256")
        if k != 1:
            sink.compact(spark, prefix, "content_sha256", "generated_at")
    return spark.read.parquet(*sink.live_paths(spark, prefix)).select("content_sha256", "generated_at")


@query("SELECT 1 AS version, count(*) AS rows_before, count(DISTINCT content_sha256) AS rows_after FROM story_signals WHERE content_sha256 IS NOT NULL")
def compaction_run(spark, folder):
    """What a compaction reports."""
    s, prefix = table(spark, folder, "story_signals").where("content_sha256 is not null"), f"{_folder(spark)}/story_signals"
    for k in (0, 1):
        sink.append_shard(s.where(F.pmod(F.xxhash64("content_sha256"), F.lit(2)) == k), prefix, "content_sha256")
    return sink.compact(spark, prefix, "content_sha256", "generated_at", expected_version=0).select("version", "rows_before", "rows_after")


@query(MART_SQL["semantic_trends"])
def json_mart(spark, folder):
    """The trend mart written as JSON and read back (S15, K12, T-9)."""
    path = f"{_folder(spark)}/trends"
    cube = marts.trend_cube(_covered(spark, folder))
    sink.write_json(marts.ordered("trends", cube), path)
    return source.load_json(spark, path, ", ".join(f"{n} {t}" for n, t in cube.dtypes))


@query(f"SELECT story_id, 384 AS dims FROM ({MART_SQL['semantic_index']})")
def published_index(spark, folder):
    """The index written and loaded, its sizes checked."""
    path = f"{_folder(spark)}/index"
    sink.write_table(_index(spark, folder), path)
    n = spark.read.parquet(path).count()
    return source.load_index(spark, path, 384, n).select("story_id", F.size("vector").alias("dims"))


@query("SELECT 'kept_runs' AS name, count(*) AS rows FROM scrape_runs UNION ALL SELECT 'kept_signals', count(*) FROM story_signals")
def catalog_rows(spark, folder):
    """Rows of registered tables."""
    r, s = _t(spark, folder, "scrape_runs", "story_signals")
    source.register({"kept_runs": r, "kept_signals": s})
    return source.catalog_counts(spark, ["kept_runs", "kept_signals"])


@query("""SELECT content_sha256, max(summary) AS summary, false AS failed FROM story_signals WHERE content_sha256 IS NOT NULL AND batch_size <= 4 GROUP BY 1
UNION ALL SELECT DISTINCT content_sha256, NULL, true FROM story_signals WHERE content_sha256 IS NOT NULL AND content_sha256 NOT IN (SELECT content_sha256 FROM story_signals WHERE content_sha256 IS NOT NULL AND batch_size <= 4)""")
def checkpoint_results(spark, folder):
    """Results and failures of a run, recorded and read again; a result clears the failure."""
    s, c = table(spark, folder, "story_signals").where("content_sha256 is not null"), Checkpoint(spark, _folder(spark))
    c.record_failures(s.select("content_sha256", F.repeat(F.lit("x"), F.lit(3000)).alias("error")).distinct())
    c.record(s.where("batch_size <= 4").groupBy("content_sha256").agg(F.max("summary").alias("summary")))
    done = c.results("content_sha256 string, summary string").withColumn("failed", F.lit(False))
    return done.unionByName(c.failures().where(F.length("error") == 2000).select("content_sha256", F.lit(None).cast("string").alias("summary"), F.lit(True).alias("failed")))


_LABELS = """l AS (SELECT content_sha256 AS id, any_value(topic) AS topic, any_value(event_type) AS event_type, (row_number() OVER (ORDER BY content_sha256) - 1) // 8 AS batch_id, (row_number() OVER (ORDER BY content_sha256) - 1) % 8 AS place
  FROM (SELECT content_sha256, lower(trim(topic)) AS topic, coalesce(nullif(lower(trim(event_type)), ''), 'other') AS event_type FROM story_signals
    WHERE content_sha256 IS NOT NULL AND trim(summary) <> '' AND trim(event_label) <> '' AND len(list_filter(themes, lambda t: t IS NOT NULL AND trim(t) <> '')) > 0
      AND lower(trim(topic)) IN ('politics', 'world', 'business', 'science_and_environment', 'technology', 'health', 'education', 'culture', 'sport', 'other')
    QUALIFY row_number() OVER (PARTITION BY content_sha256 ORDER BY generated_at DESC, topic, event_type) = 1) GROUP BY content_sha256)"""


@query(f"WITH {_LABELS} SELECT batch_id, place::INT AS place, id, topic, event_type FROM l WHERE batch_id % 5 <> 0")
def batch_labels(spark, folder):
    """Labels of batches parsed from JSON; a batch with an article that wasn't asked for is rejected as a whole."""
    from pyspark.sql import Window

    s = table(spark, folder, "story_signals").where("content_sha256 is not null and trim(summary) <> '' and trim(event_label) <> ''")
    s = s.where(F.size(F.coalesce(text.string_list(F.col("themes"), 5), F.array().cast("array<string>"))) > 0).where(F.lower(F.trim("topic")).isin(text.TOPICS))
    one = latest.latest_by(s, ["content_sha256"], [F.col("generated_at").desc(), F.lower(F.trim("topic")), F.coalesce(F.nullif(F.lower(F.trim("event_type")), F.lit("")), F.lit("other"))])
    n = F.row_number().over(Window.orderBy("content_sha256")) - 1  # a table of contents' ids; what is labelled next comes in small runs
    rows = one.withColumns({"batch_id": F.floor(n / 8), "place": n % 8})
    said = F.struct(F.when((F.col("batch_id") % 5 == 0) & (F.col("place") == 0), F.lit("another")).otherwise(F.col("content_sha256")).alias("id"), "topic", "themes", "summary", "named_entities", "event_label", "event_type", "story_form")
    rows = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("place", "content_sha256", said.alias("said")))).alias("r"))
    batches = rows.select("batch_id", F.to_json(F.struct(F.transform("r", lambda x: x["said"]).alias("articles"))).alias("content"), F.transform("r", lambda x: x["content_sha256"]).alias("expected"))
    got = jsontext.parse_signal_batches(batches)
    return got.select("batch_id", "place", "id", F.col("signals.topic").alias("topic"), F.col("signals.event_type").alias("event_type"))


@query("""SELECT content_sha256, sum(p)::BIGINT AS prompt_tokens, sum(h)::BIGINT AS hits, sum(greatest(0, p - h))::BIGINT AS misses, sum(c)::BIGINT AS completion_tokens
FROM (SELECT content_sha256, prompt_tokens AS p, CASE WHEN batch_size % 2 = 0 THEN prompt_cache_hit_tokens ELSE 0 END AS h, completion_tokens AS c FROM story_signals) GROUP BY 1""")
def usage_parse(spark, folder):
    """Token counts from JSON, with their fallbacks."""
    s = table(spark, folder, "story_signals")
    details = F.when(F.col("batch_size") % 2 == 0, F.struct(F.col("prompt_cache_hit_tokens").alias("cached_tokens")))
    u = jsontext.parse_usage(F.to_json(F.struct("prompt_tokens", "completion_tokens", details.alias("prompt_tokens_details"))))
    each = s.select("content_sha256", u.alias("u"))
    return each.groupBy("content_sha256").agg(F.sum("u.prompt_tokens").alias("prompt_tokens"), F.sum("u.cache_hit_tokens").alias("hits"), F.sum("u.cache_miss_tokens").alias("misses"), F.sum("u.completion_tokens").alias("completion_tokens"))


@query("""SELECT DISTINCT content_sha256, trim(regexp_replace(event_label, '\\s+', ' ', 'g')) AS answer, CASE WHEN cluster_size BETWEEN 1 AND 5 THEN 2 ELSE 1 END AS findings FROM recurring_events WHERE trim(event_label) <> '' AND trim(title) <> ''""")
def answer_parse(spark, folder):
    """Answers parsed from JSON: findings with a claim and a valid source stay."""
    e = table(spark, folder, "recurring_events").where("trim(event_label) <> '' and trim(title) <> ''").select("content_sha256", "event_label", "title", "cluster_size").distinct()
    finding = lambda claim, *sources: F.struct(claim.alias("claim"), F.array(*sources).alias("sources"))
    found = F.array(finding(F.col("title"), F.lit("2"), F.lit("77")), finding(F.lit("  "), F.lit("1"), F.lit("1")), finding(F.lit("one"), F.col("cluster_size").cast("string"), F.lit("0.5")))
    said = F.to_json(F.struct(F.col("event_label").alias("answer"), found.alias("findings"), F.lit("").alias("limitations")))
    return e.select("content_sha256", jsontext.parse_answer(said, F.lit(5)).alias("a")).where("a.error is null").select("content_sha256", F.col("a.answer").alias("answer"), F.size("a.findings").alias("findings")).distinct()


@query("""SELECT DISTINCT scrape_id, sha256('{"scrape_id":"' || scrape_id || '","surface":"' || surface || '"}') AS request_key FROM observations""")
def request_keys(spark, folder):
    """Cache keys of requests."""
    o = table(spark, folder, "observations").select("scrape_id", "surface").distinct()
    return o.select("scrape_id", jsontext.request_key(F.col("scrape_id"), F.col("surface")).alias("request_key")).distinct()


@query("""SELECT DISTINCT scrape_id, date_trunc('second', completed_at) AS parsed, date_trunc('second', completed_at) AS coerced, (completed_at::DATE + 1) + INTERVAL 2 HOURS AS inferred, completed_at::DATE - 1 AS collected,
  CASE WHEN epoch((SELECT max(completed_at) FROM scrape_runs)) - epoch(completed_at) < 10800 AND floor(epoch((SELECT max(completed_at) FROM scrape_runs))) - floor(epoch(completed_at)) < 10800 THEN 'Current' ELSE 'Delayed' END AS fresh,
  date_trunc('month', completed_at) = date_trunc('month', (SELECT max(completed_at) FROM scrape_runs)) AS this_month, (SELECT max(completed_at) FROM scrape_runs)::DATE - 1 AS default_day
FROM scrape_runs WHERE completed_at IS NOT NULL""")
def time_forms(spark, folder):
    """Legacy and ISO times, inferred fetches, collection days, freshness, the current month, the default day."""
    r = table(spark, folder, "scrape_runs").where("completed_at is not null")
    now, at = r.agg(F.max("completed_at")).scalar(), F.col("completed_at")
    return r.select(
        "scrape_id", times.from_utc_text(F.date_format(at, "yyyy-MM-dd HH:mm:ss 'UTC'")).alias("parsed"), times.coerce_utc(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).alias("coerced"), times.inferred_fetch(F.to_date(at)).alias("inferred"),
        times.collection_day(at).alias("collected"), times.freshness(at, now).alias("fresh"), times.this_month(at, now).alias("this_month"), times.default_day(now).alias("default_day"),
    ).distinct()


@query("""SELECT DISTINCT snapshot_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
  list_sort(list_distinct(list_filter(list_transform(string_split(array_to_string(authors, ' ; '), ';'), lambda x: trim(x)), lambda x: x <> ''))) AS authors, 'https://search.example/?q=' || story_id AS link FROM article_snapshots""")
def text_forms(spark, folder):
    """Escaped titles, authors parted from one text, search links."""
    a = table(spark, folder, "article_snapshots")
    return a.select("snapshot_id", text.escape_html(F.col("title")).alias("escaped"), text.split_authors(F.array_join("authors", " ; ")).alias("authors"), text.search_link("https://search.example/?q=", F.col("story_id")).alias("link")).distinct()


@query("SELECT DISTINCT replace(event_type, '_', ' ') AS label, event_type FROM story_signals WHERE event_type IS NOT NULL")
def human_labels(spark, folder):
    return table(spark, folder, "story_signals").where("event_type is not null").select(text.human_label(F.col("event_type")).alias("label"), "event_type").distinct()


@query("""SELECT DISTINCT content_sha256, round(greatest(-1.0, least(1.0, coalesce(similarity_to_anchor::DOUBLE * 3 - 1.5, 0))), 6) AS clamped FROM recurring_events""")
def clamped_similarities(spark, folder):
    """Numbers given as text, between -1 and 1; what is no number is 0."""
    e = table(spark, folder, "recurring_events")
    said = (F.col("similarity_to_anchor").cast("double") * 3 - 1.5).cast("string")
    return e.select("content_sha256", F.round(numbers.clamp_similarity(F.coalesce(said, F.lit("none"))), 6).alias("clamped")).distinct()


@query("SELECT doc_id, CASE WHEN strlen(text) <= 64 THEN strlen(text) END AS short_bytes, strlen(text) > 64 AS was_cut, true AS is_prefix FROM documents WHERE text IS NOT NULL")
def truncated_texts(spark, folder):
    """Texts cut to 64 bytes: a prefix of at most so many, and of more than 60 where something was cut."""
    d = table(spark, folder, "documents").where("text is not null")
    d = d.select("doc_id", "text", text.truncate_utf8(F.col("text"), 64).alias("cut"))
    n, whole = F.octet_length("cut"), F.octet_length("text")
    return d.select("doc_id", F.when(whole <= 64, n).alias("short_bytes"), (whole > n).alias("was_cut"), (F.startswith("text", F.col("cut")) & ((whole <= 64) | n.between(61, 64))).alias("is_prefix"))


@query("""SELECT content_sha256, 'left' AS side FROM (SELECT content_sha256 FROM story_signals WHERE content_sha256 IS NOT NULL EXCEPT SELECT content_sha256 FROM article_embeddings)
UNION ALL SELECT content_sha256, 'right' FROM (SELECT content_sha256 FROM article_embeddings WHERE content_sha256 IS NOT NULL EXCEPT SELECT content_sha256 FROM story_signals)""")
def set_differences(spark, folder):
    """Keys that only one of two tables has."""
    s, e = (t.where("content_sha256 is not null") for t in _t(spark, folder, "story_signals", "article_embeddings"))
    return latest.same_keys(s, e, "content_sha256")


@query("""SELECT DISTINCT observed_at AS observed_at, 'most_read' AS surface, position, 'https://paper.example/' || story_id AS url FROM (SELECT date_trunc('second', observed_at) AS observed_at, position, story_id FROM observations WHERE surface = 'most_read')""")
def legacy_round_trip(spark, folder):
    """Observations written as legacy CSVs and migrated."""
    o, path = table(spark, folder, "observations").where("surface = 'most_read'"), _folder(spark)
    old = o.select(F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss 'UTC'").alias("timestamp"), F.col("position").alias("rank"), F.col("story_id").alias("title"), F.concat(F.lit("/"), "story_id").alias("link")).distinct()
    old.repartition(8).write.option("header", "true").csv(path)
    rows = migration.legacy_rows(spark, path)
    return migration.legacy_observations(rows, F.lit("most_read"), "https://paper.example").select("observed_at", "surface", "position", "url").distinct()


@query("SELECT 'files' AS part, count(DISTINCT CAST(started_at AS DATE)) AS n FROM scrape_runs UNION ALL SELECT 'rows', count(*) FROM scrape_runs WHERE started_at IS NOT NULL")
def migration_manifest(spark, folder):
    """A table written by days with a manifest of its files, and their rows."""
    r = table(spark, folder, "scrape_runs").where("started_at is not null")
    m = migration.migrate_days(r, f"{_folder(spark)}/scrape_runs", "started_at", "0" * 40)
    m = m.where((F.length("digest") == 64) & (F.col("bytes") > 0)).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))
    return m.unpivot([], ["files", "rows"], "part", "n")


@query("SELECT CAST(fetched_at AS DATE) AS day, count(*) AS rows, count(DISTINCT snapshot_id) AS snapshots FROM article_snapshots GROUP BY 1")
def legacy_parquet_days(spark, folder):
    """Parquet files named by their day, read with it."""
    a, path = table(spark, folder, "article_snapshots").select("snapshot_id", "title", F.to_date("fetched_at").alias("d")), _folder(spark)
    sink.write_table(a.repartition("d"), f"{path}/all", partition_by=["d"])
    fs, top = sink._fs(spark, f"{path}/all")
    for f in fs.listStatus(top):  # a file for each day, as old stores have
        day = f.getPath().getName()
        for k, one in enumerate(fs.listStatus(f.getPath()) if f.isDirectory() else []):
            if one.getPath().getName().endswith(".parquet"):
                sink.rename(spark, one.getPath().toString(), f"{path}/all/{day.removeprefix('d=')}.parquet" if not k else f"{path}/all/{k}-{day.removeprefix('d=')}.parquet")
    got = migration.legacy_parquet(spark, f"{path}/all", "snapshot_id string, title string, article_html string")
    return got.groupBy("day").agg(F.count("*").alias("rows"), F.countDistinct("snapshot_id").alias("snapshots"))


@query("SELECT count(DISTINCT snapshot_id) AS snapshots, count(*) AS rows FROM raw_article_snapshots WHERE article_html IS NOT NULL")
def page_companion(spark, folder):
    """The part of article rows with their pages, kept apart from the public one (K5, K6)."""
    r, root = table(spark, folder, "raw_article_snapshots"), _folder(spark)
    public, pages = sink.split_articles(r)
    assert "article_html" not in public.columns
    sink.write_table(pages, f"{root}/raw_article_snapshots")
    back = source.read_prefix(spark, root, "raw_article_snapshots").select(*schemas.TABLES["raw_article_snapshots"].names)
    return back.agg(F.countDistinct("snapshot_id").alias("snapshots"), F.count("*").alias("rows"))


@query("""WITH l AS (SELECT scrape_id, surface, story_id, row_number() OVER (PARTITION BY scrape_id, surface ORDER BY p, story_id) AS position FROM (SELECT scrape_id, surface, story_id, min(position) AS p FROM observations GROUP BY ALL)),
b AS (SELECT scrape_id FROM l GROUP BY 1 HAVING count(DISTINCT surface) = 2)
SELECT scrape_id, surface, position::INT AS position, story_id || ' & "co"' AS title, '/news/' || story_id AS url, NULL::VARCHAR AS error FROM l WHERE position <= 10 AND scrape_id IN (SELECT scrape_id FROM b)
UNION ALL SELECT DISTINCT scrape_id, NULL, NULL, NULL, NULL, CASE WHEN surface = 'most_read' THEN 'no front_page list' ELSE 'no most_read list' END FROM l WHERE scrape_id NOT IN (SELECT scrape_id FROM b)""")
def rendered_homepages(spark, folder):
    """The lists of every capture as a home page, read back; a page without one of them fails as a whole."""
    from quillspark.sources import pages

    o = table(spark, folder, "observations").groupBy("scrape_id", "surface", "story_id").agg(F.min("position").alias("p"))
    item = F.transform(F.array_sort(F.collect_list(F.struct("p", "story_id"))), lambda x: F.concat(F.lit('<li><a href="/news/'), x["story_id"], F.lit('"><span>'), text.escape_html(F.concat(x["story_id"], F.lit(' & "co"'))), F.lit("</span></a></li>")))
    lists = o.groupBy("scrape_id", "surface").agg(F.array_join(item, "\n").alias("items"))
    front = F.concat(F.lit('<div data-entityid="container-top-stories#1"><ul>'), "items", F.lit("</ul></div>"))
    read = F.concat(F.lit('<section data-component="mostRead"><ol>'), "items", F.lit("</ol></section>"))
    page = lists.groupBy("scrape_id").agg(F.array_join(F.collect_list(F.when(F.col("surface") == "front_page", front).otherwise(read)), "<p>between</p>").alias("html"))
    return pages.parse_homepages(page, "scrape_id", "html")


@query("""SELECT DISTINCT snapshot_id, nullif(trim(canonical_url), '') AS canonical_url, trim(title) AS title, list_sort(list_distinct(list_filter(list_transform(authors, lambda x: trim(x)), lambda x: x <> ''))) AS authors,
  sha256(trim(regexp_replace(article_text, '\\s+', ' ', 'g'))) AS text_sha256 FROM article_snapshots WHERE trim(title) <> '' AND article_text <> ''""")
def rendered_articles(spark, folder):
    """Every article as a page, read back: canonical link, title, authors and text (H5)."""
    from quillspark.sources import pages

    a = table(spark, folder, "article_snapshots").where("trim(title) <> '' and article_text <> ''").select("snapshot_id", "canonical_url", "title", "authors", "article_text").distinct()
    e = text.escape_html
    by = F.array_join(F.transform("authors", lambda x: F.concat(F.lit('<a rel="author">'), e(x), F.lit("</a>"))), " ")
    page = F.concat(
        F.lit('<html><head><link rel="canonical" href="'), e(F.col("canonical_url")), F.lit('"><meta property="og:title" content="'), e(F.col("title")), F.lit('"></head><body><h1>other</h1>'), by,
        F.lit('<nav>menu</nav><div data-component="text-block"><p>'), e(F.col("article_text")), F.lit("</p><script>no()</script></div><footer>foot</footer></body></html>"),
    )
    got = pages.parse_articles(a.select("snapshot_id", page.alias("html")), "snapshot_id", "html").where("error is null")
    return got.select("snapshot_id", "canonical_url", "title", "authors", F.sha2(text.collapse_space(F.col("article_text")), 256).alias("text_sha256")).distinct()


@query("SELECT DISTINCT content_sha256, round(n / sqrt(n * n + 1), 5) AS first FROM (SELECT content_sha256, length(title)::DOUBLE AS n FROM article_snapshots)")
def embedded_texts(spark, folder):
    """Vectors of an injected model, of length one (U8, M1)."""
    from quillspark.operators import enrichment

    a = table(spark, folder, "article_snapshots").select("content_sha256", "title").distinct()
    got = enrichment.embed(a, "title", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    return got.select("content_sha256", F.round(F.col("embedding")[0].cast("double"), 5).alias("first")).distinct()


@query("SELECT DISTINCT content_sha256, sha256(content_sha256) AS response, NULL::VARCHAR AS error FROM article_snapshots WHERE fetch_ok AND content_sha256 <> ''")
def labelled_batches(spark, folder):
    """Answers of an injected client to batches of texts, each content asked for once."""
    from quillspark.operators import enrichment

    a = latest.unique_articles(table(spark, folder, "article_snapshots")).select("content_sha256", "article_text")
    got = enrichment.label(a, "content_sha256", "article_text", lambda: lambda rows: ",".join(k for k, _ in rows))
    asked = F.array_contains(F.split("response", ","), F.col("content_sha256"))
    return got.select("content_sha256", F.when(asked, F.sha2("content_sha256", 256)).alias("response"), "error")


@query("SELECT DISTINCT canonical_url AS url, CASE WHEN right(canonical_url, 1) IN ('0', '2', '4', '6', '8') THEN 200 END AS status, CASE WHEN right(canonical_url, 1) IN ('0', '2', '4', '6', '8') THEN 'page of ' || canonical_url ELSE '' END AS html, CASE WHEN right(canonical_url, 1) NOT IN ('0', '2', '4', '6', '8') THEN 'unreachable' END AS error FROM article_snapshots WHERE canonical_url IS NOT NULL")
def fetched_targets(spark, folder):
    """Every target fetched once by an injected client; failures are rows."""
    from quillspark.sources import pages

    def get(u: str) -> tuple[int, str]:
        if u[-1:] not in "02468":
            raise OSError("unreachable")
        return 200, f"page of {u}"

    return pages.fetch_pages(table(spark, folder, "article_snapshots"), "canonical_url", get, per_second=1e9)


@query("SELECT DISTINCT scrape_id, surface, position, CAST(observed_at AS DATE) AS day FROM observations")
def streamed_upsert(spark, folder):
    """Deliveries read as a stream and upserted into day partitions."""
    from quillspark.streaming import ingest

    o, root = table(spark, folder, "observations"), _folder(spark)
    o.repartition(4).write.parquet(f"{root}/in")
    rows = ingest.read_deliveries(spark, f"{root}/in", "observations", max_files=2)
    ingest.upsert_stream(rows, f"{root}/out", schemas.KEYS["observations"], "observed_at", f"{root}/mark").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("scrape_id", "surface", "position", F.to_date("observed_at").alias("day"))


@query("SELECT DISTINCT scrape_id, completed_at AS stored_at FROM scrape_runs WHERE completed_at > (SELECT max(completed_at) FROM scrape_runs) - INTERVAL 24 HOURS")
def cached_answers(spark, folder):
    """Entries of a cache that haven't expired."""
    from quillspark.operators import enrichment

    r = table(spark, folder, "scrape_runs").select("scrape_id", F.col("completed_at").alias("stored_at")).distinct()
    return enrichment.fresh_cache(r, r.agg(F.max("stored_at")).scalar())


@query("""SELECT 'once' AS way, count(DISTINCT content_sha256) AS contents FROM article_snapshots WHERE content_sha256 NOT IN (SELECT content_sha256 FROM article_embeddings WHERE content_sha256 IS NOT NULL) AND content_sha256 NOT IN (SELECT content_sha256 FROM story_signals WHERE content_sha256 IS NOT NULL)
UNION ALL SELECT 'again', count(DISTINCT content_sha256) FROM article_snapshots WHERE content_sha256 NOT IN (SELECT content_sha256 FROM article_embeddings WHERE content_sha256 IS NOT NULL)""")
def retried_candidates(spark, folder):
    """What is left to do, without and with what failed before."""
    a, e, s = _t(spark, folder, "article_snapshots", "article_embeddings", "story_signals")
    one = lambda way, again: latest.not_done(a.select("content_sha256").where("content_sha256 is not null").distinct(), e, "content_sha256", s, again).agg(F.count("*").alias("contents")).select(F.lit(way).alias("way"), "contents")
    return one("once", False).unionByName(one("again", True))


@query("SELECT content_sha256, snapshot_id, fetched_at FROM article_snapshots WHERE fetch_ok AND content_sha256 <> '' QUALIFY row_number() OVER (PARTITION BY content_sha256 ORDER BY fetched_at DESC NULLS LAST, snapshot_id DESC) = 1")
def unique_versions(spark, folder):
    """The newest good fetch of each content (P6, T-16)."""
    return latest.unique_articles(table(spark, folder, "article_snapshots")).select("content_sha256", "snapshot_id", "fetched_at")


@query(f"SELECT count(*) AS documents, 384 * count(*) AS bytes FROM ({MART_SQL['semantic_index']})")
def vector_bytes(spark, folder):
    """Quantised vectors of the index: a byte for each number, in order of stories."""
    ix = _index(spark, folder).select("story_id", "vector")
    return ix.agg(F.count("*").alias("documents"), F.sum(F.size(F.filter("vector", lambda x: x.between(-127, 127)))).alias("bytes"))
