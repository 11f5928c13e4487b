"""Registered queries over the general operators, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import ids, jsontext, text, times, vector
from quillspark.operators import enrichment, event_clusters, latest, search
from quillspark.plans import marts
from quillspark.sources import pages
from quillspark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in names]


_UNIQUE = """u AS (SELECT * FROM article_snapshots WHERE fetch_ok AND content_sha256 <> ''
  QUALIFY row_number() OVER (PARTITION BY content_sha256 ORDER BY fetched_at DESC NULLS LAST, snapshot_id DESC NULLS LAST) = 1)"""
# Rows of one content and time carry the same labels in any order, so any of them will do.
_SIGNALS = """s AS (SELECT * FROM story_signals
  QUALIFY row_number() OVER (PARTITION BY content_sha256 ORDER BY generated_at DESC NULLS LAST, prompt_version DESC NULLS LAST) = 1)"""
_COVERED = f"{_UNIQUE}, {_SIGNALS}, c AS (SELECT u.content_sha256, u.story_id, u.canonical_url, u.title, u.fetched_at, s.topic, s.themes, s.summary, s.named_entities, s.event_label, s.event_type, s.story_form FROM u JOIN s USING (content_sha256))"
_STORIES = """st AS (SELECT story_id, max({'a': observed_at, 'b': title}).b AS title, max({'a': observed_at, 'b': url}).b AS url, min(observed_at) AS first_seen, max(observed_at) AS last_seen,
  count(*) AS observation_count, min(position) AS best_position, list_sort(list_distinct(list(surface))) AS surfaces FROM observations GROUP BY story_id)"""


def _covered(spark: SparkSession, folder: str) -> DataFrame:
    return marts.labelled(*_t(spark, folder, "article_snapshots", "story_signals"))


def _stories(spark: SparkSession, folder: str) -> DataFrame:
    return marts.story_stats(table(spark, folder, "observations"))


@query(f"WITH {_STORIES} SELECT * FROM st")
def story_stats(spark, folder):
    return marts.ordered("stories", _stories(spark, folder))


@query("SELECT observed_at, surface, position, story_id, title FROM observations WHERE observed_at >= (SELECT max(observed_at) FROM observations) - INTERVAL 30 DAYS")
def rank_series_window(spark, folder):
    return marts.ordered("rank_series", marts.rank_series(table(spark, folder, "observations")))


@query("""WITH d AS (SELECT CAST(observed_at AS DATE) AS observed_date, count(DISTINCT CASE WHEN surface = 'front_page' THEN story_id END) AS front_page_stories,
  count(DISTINCT CASE WHEN surface = 'most_read' THEN story_id END) AS most_read_stories FROM observations GROUP BY 1),
o AS (SELECT observed_date, count(*) AS overlap_stories FROM (SELECT CAST(observed_at AS DATE) AS observed_date, story_id FROM observations WHERE surface IN ('front_page', 'most_read') GROUP BY 1, 2 HAVING count(DISTINCT surface) = 2) GROUP BY 1)
SELECT observed_date, front_page_stories, most_read_stories, coalesce(overlap_stories, 0) AS overlap_stories FROM d LEFT JOIN o USING (observed_date)""")
def daily_surface_overlap(spark, folder):
    return marts.daily_surfaces(table(spark, folder, "observations"))


@query("""SELECT story_id, first_front_page, first_most_read, date_diff('minute', first_front_page, first_most_read) AS lag_minutes FROM (
  SELECT story_id, min(observed_at) FILTER (surface = 'front_page') AS first_front_page, min(observed_at) FILTER (surface = 'most_read') AS first_most_read FROM observations GROUP BY story_id)
WHERE first_front_page IS NOT NULL AND first_most_read IS NOT NULL""")
def surface_lag(spark, folder):
    return marts.surface_lag(table(spark, folder, "observations"))


@query(f"WITH {_UNIQUE} SELECT content_sha256, snapshot_id, story_id, fetched_at FROM u")
def latest_per_key(spark, folder):
    return latest.unique_articles(table(spark, folder, "article_snapshots")).select("content_sha256", "snapshot_id", "story_id", "fetched_at")


@query("""WITH m AS (SELECT median(epoch_us(fetched_at)) AS cut FROM article_snapshots)
SELECT story_id, snapshot_id, title, fetched_at FROM article_snapshots, m
QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY epoch_us(fetched_at) >= cut DESC, fetched_at DESC, snapshot_id DESC) = 1""")
def upsert_merge(spark, folder):
    a = table(spark, folder, "article_snapshots").select("story_id", "snapshot_id", "title", "fetched_at")
    us = F.unix_micros("fetched_at")
    cut = a.agg(F.median(us)).scalar()
    return latest.merge_unique(a.where(us < cut), a.where(us >= cut), ["story_id"], ["fetched_at", "snapshot_id"])


@query("""SELECT 'story_signals' AS prefix, count(*) AS rows_before, count(DISTINCT content_sha256) AS rows_after FROM story_signals
UNION ALL SELECT 'article_embeddings', count(*), count(DISTINCT content_sha256) FROM article_embeddings""")
def compaction_report(spark, folder):
    out = None
    for name in ("story_signals", "article_embeddings"):
        t = table(spark, folder, name)
        kept = latest.latest_by(t.select("content_sha256", "generated_at"), ["content_sha256"], [F.col("generated_at").desc()])
        one = t.agg(F.count("*").alias("rows_before")).select(F.lit(name).alias("prefix"), "rows_before").withColumn("rows_after", kept.agg(F.count("*")).scalar())
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_UNIQUE} SELECT content_sha256, story_id, fetched_at FROM u
WHERE content_sha256 NOT IN (SELECT content_sha256 FROM story_signals WHERE content_sha256 IS NOT NULL AND model = 'labeller-small' AND prompt_version = 'labels-v2')""")
def incremental_candidates(spark, folder):
    a, s = _t(spark, folder, "article_snapshots", "story_signals")
    return enrichment.work_set(a, s, "labeller-small", "prompt_version", "labels-v2").select("content_sha256", "story_id", "fetched_at")


_CUBE = f"""{_COVERED}, cube AS (
SELECT day, dimension, value, count(*) AS count FROM (
  SELECT CAST(fetched_at AS DATE) AS day, 'topic' AS dimension, coalesce(nullif(topic, ''), 'unlabelled') AS value FROM c
  UNION ALL SELECT CAST(fetched_at AS DATE), 'story_form', coalesce(nullif(story_form, ''), 'unlabelled') FROM c
  UNION ALL SELECT CAST(fetched_at AS DATE), 'event_type', coalesce(nullif(event_type, ''), 'unlabelled') FROM c
  UNION ALL SELECT CAST(fetched_at AS DATE), 'theme', coalesce(nullif(t, ''), 'unlabelled') FROM (SELECT fetched_at, unnest(themes) AS t FROM c)) GROUP BY ALL)"""


@query(f"WITH {_CUBE} SELECT * FROM cube")
def semantic_trends(spark, folder):
    return marts.trend_cube(_covered(spark, folder))


@query(f"""WITH {_CUBE}, l AS (SELECT max(day) AS last FROM cube)
SELECT value, sum(count)::BIGINT AS total, sum(CASE WHEN day > last - 120 THEN count ELSE 0 END)::BIGINT AS recent FROM cube, l
WHERE dimension = 'theme' AND value NOT IN ('', 'unlabelled') GROUP BY value ORDER BY recent DESC, total DESC, value LIMIT 150""")
def trend_values_topk(spark, folder):
    return marts.trend_values(marts.trend_cube(_covered(spark, folder)), "theme")


@query(f"""WITH {_CUBE}, l AS (SELECT max(day) AS last FROM cube), k AS (SELECT unnest(generate_series((SELECT last FROM l) - INTERVAL 119 DAYS, (SELECT last FROM l)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day)
SELECT k.day, coalesce(cube.count, 0) AS count FROM k LEFT JOIN cube ON cube.day = k.day AND dimension = 'topic' AND value = 'politics'""")
def trend_series_dense(spark, folder):
    return marts.dense_series(marts.trend_cube(_covered(spark, folder)), "topic", "politics")


_MOMENTUM = f"""{_COVERED}, d AS (SELECT CAST(fetched_at AS DATE) AS day, themes FROM c), l AS (SELECT max(day) AS last FROM d),
w AS (SELECT last - day < 14 AS recent, themes FROM d, l WHERE last - day < 28),
tot AS (SELECT count(*) FILTER (recent) AS rt, count(*) FILTER (NOT recent) AS pt FROM w),
n AS (SELECT t AS theme, count(*) FILTER (recent) AS recent_count, count(*) FILTER (NOT recent) AS previous_count FROM (SELECT recent, unnest(themes) AS t FROM w) WHERE t IS NOT NULL GROUP BY t),
m AS (SELECT theme, recent_count, previous_count, round(CASE WHEN rt = 0 THEN 0 ELSE recent_count * 100.0::DOUBLE / rt END, 2) AS recent_share, round(CASE WHEN pt = 0 THEN 0 ELSE previous_count * 100.0::DOUBLE / pt END, 2) AS previous_share,
  round((CASE WHEN rt = 0 THEN 0 ELSE recent_count * 100.0::DOUBLE / rt END) - (CASE WHEN pt = 0 THEN 0 ELSE previous_count * 100.0::DOUBLE / pt END), 2) AS change_points FROM n, tot WHERE recent_count + previous_count >= 2)"""


@query(f"WITH {_MOMENTUM} SELECT * FROM m")
def theme_momentum(spark, folder):
    return marts.theme_momentum(_covered(spark, folder))


@query(f"WITH {_MOMENTUM} SELECT * FROM m ORDER BY change_points DESC, theme LIMIT 8")
def rising_themes(spark, folder):
    return marts.rising(marts.theme_momentum(_covered(spark, folder)))


@query(f"WITH {_MOMENTUM} SELECT * FROM m ORDER BY change_points, theme DESC LIMIT 8")
def falling_themes(spark, folder):
    return marts.falling(marts.theme_momentum(_covered(spark, folder)))


@query(f"WITH {_COVERED} SELECT coalesce(nullif(story_form, ''), 'other') AS story_form, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS share FROM c GROUP BY 1")
def form_share(spark, folder):
    return marts.form_shares(_covered(spark, folder))


_SURFACE = f"""{_COVERED}, {_STORIES}, nw AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY fetched_at DESC, content_sha256 DESC) = 1),
x AS (SELECT themes, list_contains(surfaces, 'front_page')::INT AS f, list_contains(surfaces, 'most_read')::INT AS r FROM nw JOIN st USING (story_id)),
tot AS (SELECT sum(f) AS tf, sum(r) AS tr FROM x),
n AS (SELECT t AS theme, sum(f) AS nf, sum(r) AS nr FROM (SELECT f, r, unnest(themes) AS t FROM x) WHERE t IS NOT NULL GROUP BY t),
g AS (SELECT theme, round(nf * 100.0::DOUBLE / tf, 2) AS front_page_share, round(nr * 100.0::DOUBLE / tr, 2) AS most_read_share, round(nr * 100.0::DOUBLE / tr - nf * 100.0::DOUBLE / tf, 2) AS difference_points FROM n, tot WHERE nf + nr >= 3)"""


@query(f"WITH {_SURFACE} SELECT * FROM g")
def surface_theme_shares(spark, folder):
    return marts.surface_themes(_covered(spark, folder), _stories(spark, folder))


@query(f"WITH {_SURFACE} SELECT * FROM g ORDER BY abs(difference_points) DESC, theme LIMIT 10")
def surface_theme_diff(spark, folder):
    return marts.surface_differences(marts.surface_themes(_covered(spark, folder), _stories(spark, folder)))


@query(f"""WITH {_UNIQUE} SELECT count(*) AS versions, count(*) FILTER (has) AS labelled_versions, round(count(*) FILTER (has) * 100.0::DOUBLE / count(*), 1) AS coverage_percent
FROM (SELECT content_sha256 IN (SELECT content_sha256 FROM story_signals WHERE content_sha256 IS NOT NULL) AS has FROM u)""")
def coverage(spark, folder):
    return marts.coverage(*_t(spark, folder, "article_snapshots", "story_signals"))


_RECURRING = f"""{_STORIES}, e AS (SELECT DISTINCT ON (cluster_id, content_sha256) * FROM recurring_events WHERE cluster_size > 1 ORDER BY cluster_id, content_sha256, fetched_at DESC),
v AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY cluster_id, story_id ORDER BY fetched_at DESC, content_sha256 DESC) = 1),
a AS (SELECT cluster_id, list({{'fetched_at': fetched_at, 'story_id': v.story_id, 'title': v.title, 'url': canonical_url, 'observation_count': coalesce(observation_count, 0), 'surfaces': coalesce(surfaces, [])}} ORDER BY fetched_at, v.story_id) AS articles, count(*) AS article_count
  FROM v LEFT JOIN st ON st.story_id = v.story_id GROUP BY cluster_id HAVING count(*) >= 2),
sp AS (SELECT cluster_id, min(fetched_at) AS first_seen, max(fetched_at) AS last_seen, count(*) AS version_count FROM e GROUP BY cluster_id),
lb AS (SELECT cluster_id, event_label AS label FROM e GROUP BY cluster_id, event_label QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min({{'a': fetched_at, 'b': content_sha256}})) = 1),
kd AS (SELECT cluster_id, event_type FROM e GROUP BY cluster_id, event_type QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min({{'a': fetched_at, 'b': content_sha256}})) = 1),
tx AS (SELECT cluster_id, fetched_at, content_sha256, unnest(themes) AS t, generate_subscripts(themes, 1) AS o FROM e),
tr AS (SELECT cluster_id, t, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min({{'a': fetched_at, 'b': content_sha256, 'c': o}})) AS r FROM tx GROUP BY cluster_id, t),
th AS (SELECT cluster_id, list(t ORDER BY r) AS themes FROM tr WHERE r <= 5 GROUP BY cluster_id),
rec AS (SELECT cluster_id, label, event_type, coalesce(themes, []) AS themes, first_seen, last_seen, article_count, version_count, articles FROM a JOIN sp USING (cluster_id) JOIN lb USING (cluster_id) JOIN kd USING (cluster_id) LEFT JOIN th USING (cluster_id))"""


def _recurring(spark, folder):
    return marts.recurring_stories(table(spark, folder, "recurring_events"), _stories(spark, folder))


@query(f"WITH {_RECURRING} SELECT * EXCLUDE (articles), to_json(list_transform(articles, lambda x: x.story_id)) AS story_ids FROM rec")
def recurring_rollup(spark, folder):
    return _recurring(spark, folder).withColumn("story_ids", F.to_json(F.transform("articles", lambda a: a["story_id"]))).drop("articles")


@query(f"WITH {_RECURRING} SELECT * EXCLUDE (articles) FROM rec ORDER BY article_count DESC, version_count DESC, last_seen DESC, cluster_id LIMIT 8")
def returning_stories(spark, folder):
    return marts.returning_stories(_recurring(spark, folder))


@query(f"WITH {_RECURRING} SELECT cluster_id, label, event_type, last_seen, article_count, version_count FROM rec WHERE contains(lower(concat_ws(' ', label, event_type, array_to_string(themes, ' '))), 'hous') ORDER BY last_seen DESC, article_count DESC, cluster_id LIMIT 40")
def event_page(spark, folder):
    return marts.event_page(_recurring(spark, folder), "hous")


@query(f"WITH {_STORIES} SELECT * FROM st WHERE contains(lower(title), 'the') AND list_contains(surfaces, 'most_read') ORDER BY observation_count DESC, story_id LIMIT 15 OFFSET 15")
def story_browse_page(spark, folder):
    return marts.story_page(_stories(spark, folder), "the", "most_read", "observation_count", 1)


_INDEX = f"""{_UNIQUE}, {_SIGNALS}, {_STORIES},
em AS (SELECT content_sha256, embedding::DOUBLE[] AS e FROM article_embeddings WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 QUALIFY row_number() OVER (PARTITION BY content_sha256 ORDER BY generated_at DESC) = 1),
nw AS (SELECT u.* FROM u WHERE content_sha256 IN (SELECT content_sha256 FROM em) QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY fetched_at DESC, content_sha256 DESC) = 1),
ix AS (SELECT nw.story_id, nw.content_sha256, coalesce(nullif(nw.title, ''), 'Untitled') AS title, nw.canonical_url AS url, nw.fetched_at, coalesce(summary, '') AS summary, coalesce(nullif(topic, ''), 'unlabelled') AS topic, coalesce(themes, []) AS themes,
  coalesce(nullif(event_type, ''), 'unlabelled') AS event_type, coalesce(nullif(story_form, ''), 'unlabelled') AS story_form, coalesce(observation_count, 0) AS observation_count, best_position, coalesce(surfaces, []) AS surfaces, e,
  list_max(list_transform(e, lambda x: abs(x))) / 127.0 AS scale
  FROM nw JOIN em USING (content_sha256) LEFT JOIN s ON s.content_sha256 = nw.content_sha256 LEFT JOIN st ON st.story_id = nw.story_id)"""


def _index(spark, folder):
    return marts.semantic_index(*_t(spark, folder, "article_snapshots", "story_signals", "article_embeddings"), _stories(spark, folder))


@query(f"WITH {_INDEX} SELECT * EXCLUDE (e, scale, summary, fetched_at, url), round(scale, 9) AS scale FROM ix")
def semantic_index(spark, folder):
    return _index(spark, folder).drop("vector", "norm", "summary", "fetched_at", "url").withColumn("scale", F.round("scale", 9))


@query(f"""WITH {_INDEX} SELECT story_id, list_transform(e, lambda x: round_even(x / scale, 0)::TINYINT) AS vector,
  round(sqrt(list_sum(list_transform(e, lambda x: round_even(x / scale, 0) ** 2))) * scale, 6) AS norm FROM ix""")
def vector_quantize(spark, folder):
    return _index(spark, folder).select("story_id", "vector", F.round("norm", 6).alias("norm"))


@query(f"WITH {_INDEX} SELECT DISTINCT 'topic' AS facet, topic AS value FROM ix UNION SELECT DISTINCT 'story_form', story_form FROM ix")
def facet_values(spark, folder):
    return marts.facets(_index(spark, folder))


def _embedded(spark, folder):
    """Newest usable vector of each content, and the query vector: that of the smallest content."""
    e = table(spark, folder, "article_embeddings").where((F.size("embedding") == 384) & F.exists("embedding", lambda x: x != 0))
    e = latest.latest_by(e, ["content_sha256"], [F.col("generated_at").desc(), F.xxhash64("embedding").desc()]).select(F.col("content_sha256").alias("story_id"), "embedding")
    return e, e.orderBy("story_id").limit(1).head()


_EMB = """em AS (SELECT content_sha256 AS story_id, embedding::DOUBLE[] AS e FROM article_embeddings WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 QUALIFY row_number() OVER (PARTITION BY content_sha256 ORDER BY generated_at DESC) = 1),
q AS (SELECT * FROM em ORDER BY story_id LIMIT 1), sc AS (SELECT em.story_id, list_cosine_similarity(em.e, q.e) AS score, em.story_id = q.story_id AS own FROM em, q)"""


@query(f"WITH {_EMB} SELECT story_id, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY sc.score DESC, story_id LIMIT 20")
def vector_search_topk(spark, folder):
    e, q = _embedded(spark, folder)
    return search.vector_search(e, q["embedding"]).select("story_id", F.round("score", 6).alias("score"))


@query(f"WITH {_EMB} SELECT story_id, round(score, 6) AS score FROM sc WHERE NOT own ORDER BY sc.score DESC, story_id LIMIT 6")
def related_topk(spark, folder):
    e, q = _embedded(spark, folder)
    return search.related(e, q["story_id"], q["embedding"]).select("story_id", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS score FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, id) <= 5""")
def vector_search_queries(spark, folder):
    """The stated query set, every vector whose id is divisible by 50, against all vectors."""
    e = table(spark, folder, "embeddings")
    return search.nearest_to_queries(e, e.where("vec_id % 50 = 0"), "vec_id").withColumn("score", F.round("score", 6))


@query(f"""WITH {_INDEX}, sc AS (SELECT story_id, (h + 1.5 * th) / (2.5 * 3) AS score FROM (SELECT story_id,
  list_sum([contains(lower(concat_ws(' ', title, summary, topic, array_to_string(themes, ' '))), k)::INT for k in ['harbour', 'budget', 'flooding']]) AS h,
  list_sum([contains(lower(title), k)::INT for k in ['harbour', 'budget', 'flooding']]) AS th FROM ix WHERE list_contains(surfaces, 'front_page')))
SELECT story_id, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY sc.score DESC, story_id LIMIT 20""")
def keyword_search(spark, folder):
    return search.keyword_search(_index(spark, folder), "harbour budget flooding", where=search.facet_filter(surface="front_page")).select("story_id", F.round("score", 6).alias("score"))


@query("""SELECT DISTINCT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || CASE WHEN p = '' THEN '/' ELSE p END AS canonical
FROM (SELECT url, regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM observations)""")
def url_normalize(spark, folder):
    return table(spark, folder, "observations").select("url").distinct().withColumn("canonical", ids.normalize_url(F.col("url")))


@query("SELECT DISTINCT snapshot_id, substr(sha256(canonical_url || chr(31) || strftime(fetched_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(fetched_at) % 1000000 = 0 THEN '' ELSE strftime(fetched_at, '.%f') END || '+00:00' || chr(31) || content_sha256), 1, 32) AS id, sha256(title) AS title_sha256 FROM article_snapshots")
def stable_ids(spark, folder):
    a = table(spark, folder, "article_snapshots").select("snapshot_id", "canonical_url", "fetched_at", "content_sha256", "title").distinct()
    return a.select("snapshot_id", ids.stable_id(F.col("canonical_url"), times.iso(F.col("fetched_at")), F.col("content_sha256")).alias("id"), ids.sha256(F.col("title")).alias("title_sha256")).distinct()


@query(f"""WITH {_COVERED}, t AS (SELECT content_sha256, list_distinct(regexp_extract_all(lower(coalesce(event_label, '')), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+')) AS b FROM c)
SELECT content_sha256, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 9) END AS overlap FROM t""")
def label_jaccard(spark, folder):
    c = _covered(spark, folder)
    return c.select("content_sha256", F.round(text.jaccard(text.label_tokens(F.col("event_label")), text.label_tokens(F.col("title"))), 9).alias("overlap"))


@query(f"""WITH {_SIGNALS}, k AS (
  SELECT event_type, content_sha256, unnest(list_distinct(list_filter([lower(trim(x)) for x in named_entities], lambda x: x <> '' AND x NOT IN ('uk', 'united kingdom', 'government')))) AS v, 'e:' AS p FROM s
  UNION ALL SELECT event_type, content_sha256, unnest(list_distinct(regexp_extract_all(lower(coalesce(event_label, '')), '[a-z0-9]+'))), 'l:' FROM s)
SELECT event_type, p || v AS key, count(*) AS contents FROM k WHERE v IS NOT NULL GROUP BY ALL""")
def entity_blocking_keys(spark, folder):
    return event_clusters.blocking_keys(table(spark, folder, "story_signals"))


@query(f"""WITH {_SIGNALS}, p AS (SELECT content_sha256, CASE lower(trim(topic)) WHEN 'weather' THEN 'science_and_environment' WHEN 'environment' THEN 'science_and_environment' WHEN 'science' THEN 'science_and_environment'
    WHEN 'crime' THEN 'other' WHEN 'uk' THEN 'other' WHEN 'travel' THEN 'other' WHEN 'transport' THEN 'other' WHEN 'religion' THEN 'other' WHEN 'lifestyle' THEN 'other' ELSE lower(trim(topic)) END AS t,
  list_filter([trim(x) for x in themes], lambda x: x <> '')[1:5] AS th, trim(summary) AS su, list_filter([trim(x) for x in named_entities], lambda x: x <> '')[1:8] AS ne, trim(event_label) AS el, coalesce(nullif(lower(trim(event_type)), ''), 'other') AS et FROM s)
SELECT content_sha256, CASE WHEN t IN ('politics', 'world', 'business', 'science_and_environment', 'technology', 'health', 'education', 'culture', 'sport', 'other') THEN t END AS topic, len(th) AS themes, len(coalesce(ne, [])) AS named_entities, et AS event_type,
  CASE WHEN t IS NULL OR t NOT IN ('politics', 'world', 'business', 'science_and_environment', 'technology', 'health', 'education', 'culture', 'sport', 'other') THEN 'unsupported topic' WHEN coalesce(su, '') = '' OR coalesce(el, '') = '' THEN 'no summary or event_label' WHEN th IS NULL THEN 'themes is no array' WHEN len(th) = 0 THEN 'no themes' END AS error FROM p""")
def signal_parse(spark, folder):
    s = latest.newest_signals(table(spark, folder, "story_signals"))
    body = F.to_json(F.struct("topic", "themes", "summary", "named_entities", "event_label", "event_type", "story_form"))
    p = s.select("content_sha256", jsontext.parse_signals(body).alias("p"))
    return p.select("content_sha256", "p.topic", F.size("p.themes").alias("themes"), F.size("p.named_entities").alias("named_entities"), "p.event_type", "p.error")


@query("""WITH r AS (SELECT scrape_id AS request_id, row_number() OVER (PARTITION BY scrape_id ORDER BY observed_at, surface, position, title, url) AS pos, trim(title) AS title, url FROM observations),
ok AS (SELECT * FROM r WHERE pos <= 20 AND title <> '' AND (regexp_extract(url, '^(?i:https?)://([^/?#:]+)', 1) = 'daily-ledger.example' OR regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) LIKE '%.daily-ledger.example')),
f AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY request_id, url ORDER BY pos) = 1)
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS id, url, title FROM f""")
def evidence_normalize(spark, folder):
    o = table(spark, folder, "observations").select("scrape_id", F.struct("observed_at", "surface", "position", "title", "url").alias("o"))
    rows = o.groupBy("scrape_id").agg(F.array_sort(F.collect_list("o")).alias("o"))
    body = F.to_json(F.struct(F.lit("what happened").alias("query"), F.transform("o", lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"))).alias("evidence")))
    return jsontext.normalize_evidence(rows.select(F.col("scrape_id").alias("request_id"), body.alias("body")), ["daily-ledger.example"]).select("request_id", "id", "url", "title")


@query("""SELECT doc_id, list_sort(list_distinct(list_filter([x::INT for x in regexp_extract_all(t, '\\[(\\d+)\\]', 1)], lambda x: x BETWEEN 1 AND 20))) AS cited
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '(\\d{1,6})', '[\\1]', 'g') AS t FROM documents)""")
def citations_filter(spark, folder):
    d = table(spark, folder, "documents")
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), r"(\d{1,6})", "[$1]")
    return d.select("doc_id", text.citation_numbers(marked, F.lit(20)).alias("cited"))


@query("""WITH r AS (SELECT DISTINCT deepseek_response_id AS response, content_sha256, prompt_tokens FROM story_signals),
t AS (SELECT *, max(prompt_tokens) OVER (PARTITION BY response) AS total, row_number() OVER (PARTITION BY response ORDER BY content_sha256, prompt_tokens) - 1 AS i, count(*) OVER (PARTITION BY response) AS n FROM r)
SELECT response, content_sha256, prompt_tokens, n AS batch_size, (total // n + CASE WHEN i < total % n THEN 1 ELSE 0 END)::BIGINT AS row_total FROM t""")
def usage_allocation(spark, folder):
    r = table(spark, folder, "story_signals").select(F.col("deepseek_response_id").alias("response"), "content_sha256", "prompt_tokens").distinct()
    totals = r.groupBy("response").agg(F.max("prompt_tokens").alias("total"))
    return enrichment.allocate_usage(r.join(totals, "response"), "response", ["content_sha256", "prompt_tokens"], ["total"]).drop("total")


@query("""SELECT prompt_version, round(sum(c)::DOUBLE, 6) AS total, count(*) AS records FROM (SELECT prompt_version, content_sha256, deepseek_response_id, max(request_cost_usd)::DECIMAL(38,10) AS c FROM story_signals GROUP BY ALL) GROUP BY prompt_version""")
def ledger_sum(spark, folder):
    s = table(spark, folder, "story_signals")
    d = enrichment.distinct_sum(s, ["content_sha256", "deepseek_response_id"], "request_cost_usd", ["prompt_version"])
    return d.select("prompt_version", F.round(F.col("total").cast("double"), 6).alias("total"), "records")


@query("""SELECT doc_id, n_chars, running FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id)::DOUBLE AS running FROM documents) WHERE running <= 50000""")
def budget_prefix(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "n_chars")
    return enrichment.affordable_prefix(d, "n_chars", ["doc_id"], 50_000).withColumn("running", F.col("running").cast("double"))


@query("SELECT url, min(observed_at) AS first_observed_at FROM observations GROUP BY url")
def first_seen_targets(spark, folder):
    return marts.first_seen(table(spark, folder, "observations"))


@query("""SELECT snapshot_id, f AS first_observed_at, f IS NULL AS inferred FROM (SELECT DISTINCT snapshot_id, canonical_url FROM article_snapshots) a LEFT JOIN (SELECT url, min(observed_at) AS f FROM observations GROUP BY url) o ON o.url = a.canonical_url""")
def first_seen_repair(spark, folder):
    a, o = _t(spark, folder, "article_snapshots", "observations")
    f = marts.first_seen(o).withColumnRenamed("url", "canonical_url")
    return a.select("snapshot_id", "canonical_url").distinct().join(f, "canonical_url", "left").select("snapshot_id", "first_observed_at", F.col("first_observed_at").isNull().alias("inferred"))


@query("""SELECT scrape_id, surface, story_id, title, row_number() OVER (PARTITION BY scrape_id, surface ORDER BY position, story_id, title) AS ordinal FROM (SELECT DISTINCT scrape_id, surface, position, story_id, title FROM observations)""")
def legacy_positions(spark, folder):
    from quillspark.sources.migration import dense_positions

    o = table(spark, folder, "observations").select("scrape_id", "surface", "position", "story_id", "title").distinct()
    return dense_positions(o, ["scrape_id", "surface"], ["position", "story_id", "title"]).drop("position")


@query("SELECT content_sha256, generated_at, shard FROM (SELECT content_sha256, generated_at, (row_number() OVER (ORDER BY generated_at, content_sha256, model_revision) - 1) // 256 AS shard FROM (SELECT DISTINCT content_sha256, generated_at, model_revision FROM article_embeddings)) QUALIFY count(*) OVER (PARTITION BY shard) = 256")
def shard_assignment(spark, folder):
    e = table(spark, folder, "article_embeddings").select("content_sha256", "generated_at", "model_revision").distinct()
    return enrichment.assign_shards(e, ["generated_at", "content_sha256", "model_revision"]).select("content_sha256", "generated_at", "shard")


@query("SELECT scrape_id, count(*) FILTER (surface = 'front_page') AS front_page_count, count(*) FILTER (surface = 'most_read') AS most_read_count FROM observations GROUP BY scrape_id")
def run_summary(spark, folder):
    return marts.run_summary(table(spark, folder, "observations"))


@query("SELECT count(DISTINCT cluster_id) AS clusters, count(DISTINCT CASE WHEN cluster_size > 1 THEN cluster_id END) AS recurring FROM recurring_events")
def cluster_counts(spark, folder):
    e = table(spark, folder, "recurring_events")
    return e.agg(F.countDistinct("cluster_id").alias("clusters"), F.countDistinct(F.when(F.col("cluster_size") > 1, F.col("cluster_id"))).alias("recurring"))


@query("""SELECT 'both' AS side, count(*) AS keys FROM (SELECT content_sha256 FROM story_signals WHERE content_sha256 IS NOT NULL INTERSECT SELECT content_sha256 FROM article_embeddings)
UNION ALL SELECT 'either', count(*) FROM (SELECT content_sha256 FROM story_signals WHERE content_sha256 IS NOT NULL UNION SELECT content_sha256 FROM article_embeddings WHERE content_sha256 IS NOT NULL)
UNION ALL SELECT 'signals_only', count(*) FROM (SELECT content_sha256 FROM story_signals WHERE content_sha256 IS NOT NULL EXCEPT SELECT content_sha256 FROM article_embeddings)""")
def key_sets(spark, folder):
    s, e = (t.select("content_sha256").where("content_sha256 is not null") for t in _t(spark, folder, "story_signals", "article_embeddings"))
    one = lambda n, d: d.agg(F.count("*").alias("keys")).select(F.lit(n).alias("side"), "keys")
    return one("both", s.intersect(e)).unionByName(one("either", s.union(e).distinct())).unionByName(one("signals_only", s.distinct().join(e, "content_sha256", "left_anti")))


@query("SELECT DISTINCT r.snapshot_id, s.story_id, strlen(r.article_html) AS html_bytes, sha256(r.article_html) = r.html_sha256 AS digest_ok FROM raw_article_snapshots r JOIN article_snapshots s USING (snapshot_id)")
def raw_join(spark, folder):
    r, s = _t(spark, folder, "raw_article_snapshots", "article_snapshots")
    slim = r.select("snapshot_id", F.octet_length("article_html").alias("html_bytes"), (ids.sha256(F.col("article_html")) == F.col("html_sha256")).alias("digest_ok")).distinct()
    return slim.join(s.select("snapshot_id", "story_id").distinct(), "snapshot_id")


@query("""SELECT DISTINCT snapshot_id, sha256(trim(t || chr(10) || chr(10) || CASE WHEN t <> '' AND starts_with(b, t) THEN left(regexp_replace(substr(b, length(t) + 1), '^[ .:-]+', ''), 4000) ELSE left(b, 4000) END, ' ' || chr(10))) AS text_sha256
FROM (SELECT snapshot_id, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS t, trim(regexp_replace(coalesce(article_text, ''), '\\s+', ' ', 'g')) AS b FROM article_snapshots)""")
def embedding_texts(spark, folder):
    a = table(spark, folder, "article_snapshots").select("snapshot_id", "title", "article_text").distinct()
    return a.select("snapshot_id", ids.sha256(text.embedding_text(F.col("title"), F.col("article_text"))).alias("text_sha256")).distinct()


@query("SELECT scrape_id, strftime(c, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(c) % 1000000 = 0 THEN '' ELSE strftime(c, '.%f') END || '+00:00' AS completed FROM (SELECT scrape_id, max(completed_at) AS c FROM scrape_runs GROUP BY scrape_id)")
def iso_times(spark, folder):
    return table(spark, folder, "scrape_runs").groupBy("scrape_id").agg(F.max("completed_at").alias("c")).select("scrape_id", times.iso(F.col("c")).alias("completed"))


@query("SELECT observed_date, count(*) AS rows FROM (SELECT CAST(observed_at AS DATE) AS observed_date, max(CAST(observed_at AS DATE)) OVER () AS last FROM observations) WHERE observed_date < last GROUP BY 1 ORDER BY 1 DESC LIMIT 120")
def completed_days(spark, folder):
    return marts.completed_days(table(spark, folder, "observations"))


@query("SELECT story_id, observed_at, surface, position FROM observations")
def story_points(spark, folder):
    return marts.story_points(table(spark, folder, "observations"))


@query("SELECT content_sha256, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])), 6) AS length FROM article_embeddings WHERE len(embedding) = 384")
def vector_norms(spark, folder):
    return table(spark, folder, "article_embeddings").where(F.size("embedding") == 384).select("content_sha256", F.round(vector.norm(F.col("embedding")), 6).alias("length"))


@query("""SELECT date_trunc('month', fetched_at)::DATE AS month, count(DISTINCT snapshot_id) AS snapshots FROM article_snapshots GROUP BY 1""")
def bounded_sql(spark, folder):
    from quillspark.plans.sqltools import run_sql

    tables = {"article_snapshots": table(spark, folder, "article_snapshots")}
    return run_sql(spark, tables, "SELECT CAST(date_trunc('MONTH', fetched_at) AS DATE) AS month, count(DISTINCT snapshot_id) AS snapshots FROM article_snapshots GROUP BY 1")


@query()
def cluster_events(spark, folder):
    return event_clusters.cluster_events(*_t(spark, folder, "article_snapshots", "story_signals", "article_embeddings"))


@query()
def html_articles(spark, folder):
    r = table(spark, folder, "raw_article_snapshots").select("snapshot_id", "article_html")
    return pages.parse_articles(r, "snapshot_id", "article_html")


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS client, ts AS "at", event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
w AS (
  SELECT client, "at", event_id, i, [us] AS taken, true AS admitted FROM e WHERE i = 1
  UNION ALL
  SELECT e.client, e."at", e.event_id, e.i,
    CASE WHEN len(list_filter(w.taken, lambda t: t > e.us - 600000000)) < 5 THEN list_append(list_filter(w.taken, lambda t: t > e.us - 600000000), e.us) ELSE w.taken END,
    len(list_filter(w.taken, lambda t: t > e.us - 600000000)) < 5
  FROM w JOIN e ON e.client = w.client AND e.i = w.i + 1)
SELECT client, "at", event_id, admitted FROM w""")
def rate_limit_window(spark, folder):
    from quillspark.streaming.rate_limit import admit_batch

    e = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("client"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id"))
    return admit_batch(e, "client", "at", "event_id")


_MARTS = {
    "stories": "story_stats", "rank_series": "rank_series_window", "daily": "daily_surface_overlap", "lag": "surface_lag", "trends": "semantic_trends", "rising_themes": "rising_themes", "falling_themes": "falling_themes",
    "story_forms": "form_share", "surface_differences": "surface_theme_diff", "coverage": "coverage", "recurring": "recurring_rollup", "returning": "returning_stories", "semantic_index": "semantic_index",
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM ({SQL[q]})" for n, q in _MARTS.items()) + " UNION ALL SELECT 'findings_window', 1")
def mart_manifest(spark, folder):
    names = ("observations", "article_snapshots", "story_signals", "article_embeddings", "recurring_events")
    return marts.build_marts(*_t(spark, folder, *names))["manifest"]


@query(f"""WITH {_COVERED}, d AS (SELECT count(*) AS versions, max(fetched_at)::DATE AS last FROM c)
SELECT versions, last - 13 AS recent_from, last AS recent_to, last - 27 AS previous_from, last - 14 AS previous_to FROM d""")
def findings_window(spark, folder):
    return marts.findings_window(_covered(spark, folder))
