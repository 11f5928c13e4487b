"""The published marts, as DataFrames over stored tables (A1-A30, T-1 to T-21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions.numbers import percent
from quillspark.functions.text import or_default
from quillspark.functions.times import minute_boundaries
from quillspark.functions.vector import quantized
from quillspark.operators.latest import latest_by, newest_signals, unique_articles
from quillspark.sinks.tables import write_json, write_table

SURFACES = ("front_page", "most_read")
#: The order that each published mart comes in (T-1 to T-4, T-8, T-9, T-18). Marts that feed others stay unordered.
ORDERS: dict[str, list[tuple[str, bool]]] = {
    "stories": [("last_seen", False), ("observation_count", False), ("story_id", True)],
    "rank_series": [("observed_at", True), ("surface", True), ("position", True), ("story_id", True)],
    "daily": [("observed_date", True)],
    "lag": [("first_most_read", False), ("story_id", True)],
    "trends": [("day", True), ("dimension", True), ("value", True)],
    "recurring": [("last_seen", False), ("article_count", False), ("cluster_id", True)],
    "recurring_events": [("cluster_id", True), ("fetched_at", True), ("content_sha256", True)],
}


def ordered(name: str, mart: DataFrame) -> DataFrame:
    """``mart`` in the order in which ``name`` is published."""
    return mart.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in ORDERS[name]]) if name in ORDERS else mart


def story_stats(observations: DataFrame) -> DataFrame:
    """Per story: its newest title and URL, first and last sight, count, best position and surfaces. One partial aggregation, so hot stories don't matter."""
    return observations.groupBy("story_id").agg(
        F.max(F.struct("observed_at", "title"))["title"].alias("title"),
        F.max(F.struct("observed_at", "url"))["url"].alias("url"),
        F.min("observed_at").alias("first_seen"),
        F.max("observed_at").alias("last_seen"),
        F.count("*").alias("observation_count"),
        F.min("position").alias("best_position"),
        F.sort_array(F.collect_set("surface")).alias("surfaces"),
    )


def rank_series(observations: DataFrame, days: int = 30) -> DataFrame:
    """Positions of the last days before the latest observation, inclusive."""
    latest = observations.agg(F.max("observed_at")).scalar()
    o = observations.where(F.col("observed_at") >= latest - F.make_interval(days=F.lit(days)))
    return o.select("observed_at", "surface", "position", "story_id", "title")


def daily_surfaces(observations: DataFrame) -> DataFrame:
    """Per day the different stories of each surface and those on both. Pairs of day and story are formed once and counted."""
    seen = observations.groupBy(F.to_date("observed_at").alias("observed_date"), "story_id").agg(*[F.max(F.col("surface") == s).alias(s) for s in SURFACES])
    count = lambda c: F.count_if(c)
    return seen.groupBy("observed_date").agg(count(F.col("front_page")).alias("front_page_stories"), count(F.col("most_read")).alias("most_read_stories"), count(F.col("front_page") & F.col("most_read")).alias("overlap_stories"))


def surface_lag(observations: DataFrame) -> DataFrame:
    """Stories seen on both surfaces and the minutes from the front page to the other list; negative if it was there first."""
    first = observations.groupBy("story_id").agg(*[F.min(F.when(F.col("surface") == s, F.col("observed_at"))).alias(f"first_{s}") for s in SURFACES])
    both = first.where("first_front_page is not null and first_most_read is not null")
    return both.withColumn("lag_minutes", minute_boundaries(F.col("first_front_page"), F.col("first_most_read")).cast("long"))


def labelled(articles: DataFrame, signals: DataFrame) -> DataFrame:
    """Newest good version of each content with its newest labels."""
    a = unique_articles(articles).select("content_sha256", "story_id", "canonical_url", "title", "fetched_at")
    s = newest_signals(signals).select("content_sha256", "topic", "themes", "summary", "named_entities", "event_label", "event_type", "story_form")
    return a.join(s, "content_sha256")


def trend_cube(covered: DataFrame) -> DataFrame:
    """``day, dimension, value, count`` of article versions over topic, story form, event type and theme; no value is ``unlabelled``."""
    one = covered.select(F.to_date("fetched_at").alias("day"), *[or_default(F.col(c), "unlabelled").alias(c) for c in ("topic", "story_form", "event_type")], "themes")
    dims = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("topic", "story_form", "event_type")])
    themes = F.transform(F.coalesce("themes", F.array().cast("array<string>")), lambda t: F.struct(F.lit("theme").alias("dimension"), or_default(t, "unlabelled").alias("value")))
    return one.select("day", F.inline(F.concat(dims, themes))).groupBy("day", "dimension", "value").agg(F.count("*").alias("count"))


def trend_values(cube: DataFrame, dimension: str, days: int = 120, most: int = 150) -> DataFrame:
    """The values of a dimension with most versions in the last days, for choosing from."""
    latest = cube.agg(F.max("day")).scalar()
    c = cube.where((F.col("dimension") == dimension) & (F.col("value") != "") & (F.col("value") != "unlabelled"))
    recent = F.sum(F.when(F.col("day") > F.date_sub(latest, days), F.col("count")).otherwise(0)).alias("recent")
    v = c.groupBy("value").agg(F.sum("count").alias("total"), recent)
    return v.orderBy(F.col("recent").desc(), F.col("total").desc(), "value").limit(most)


def dense_series(cube: DataFrame, dimension: str, value: str, days: int = 120) -> DataFrame:
    """A count for each of the last days, 0 where there is none."""
    latest = cube.agg(F.max("day").alias("last"))
    calendar = latest.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"), F.expr("INTERVAL 1 DAY"))).alias("day"))
    got = cube.where((F.col("dimension") == dimension) & (F.col("value") == value)).select("day", "count")
    return calendar.join(got, "day", "left").select("day", F.coalesce("count", F.lit(0)).alias("count"))


def theme_momentum(covered: DataFrame, days: int = 14, support: int = 2) -> DataFrame:
    """Themes by their share in the latest days and in as many before: counts, shares and change in percentage points.

    Shares are of labelled versions, not of themes; a theme repeated in one version counts each time.
    """
    d = covered.select(F.to_date("fetched_at").alias("day"), "themes")
    latest = d.agg(F.max("day")).scalar()
    age = F.date_diff(latest, F.col("day"))
    d = d.where(age < 2 * days).withColumn("recent", age < days)
    # One pass gives both totals and theme counts: the null theme stands for the version itself.
    each = d.select("recent", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.filter("themes", lambda t: t.isNotNull()), F.array().cast("array<string>")))).alias("theme"))
    n = each.groupBy("theme").agg(F.count_if("recent").alias("recent_count"), F.count_if(~F.col("recent")).alias("previous_count"))
    totals = n.where("theme is null").select(F.struct("recent_count", "previous_count")).scalar()
    t = n.where("theme is not null").where(F.col("recent_count") + F.col("previous_count") >= support).withColumn("all", totals)
    r, p = percent(F.col("recent_count"), F.col("all.recent_count")), percent(F.col("previous_count"), F.col("all.previous_count"))
    return t.select("theme", "recent_count", "previous_count", F.round(r, 2).alias("recent_share"), F.round(p, 2).alias("previous_share"), F.round(r - p, 2).alias("change_points"))


def rising(momentum: DataFrame, most: int = 8) -> DataFrame:
    return momentum.orderBy(F.col("change_points").desc(), "theme").limit(most)


def falling(momentum: DataFrame, most: int = 8) -> DataFrame:
    """The last ones of the rising order."""
    return momentum.orderBy("change_points", F.col("theme").desc()).limit(most)


def form_shares(covered: DataFrame) -> DataFrame:
    n = covered.groupBy(or_default(F.col("story_form"), "other").alias("story_form")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))  # a row per form
    return n.withColumn("share", F.round(percent(F.col("count"), total), 1))


def surface_themes(covered: DataFrame, stories: DataFrame, support: int = 3) -> DataFrame:
    """Themes of the newest labelled version of each story by surface, and the difference of shares. J6, A12."""
    newest = latest_by(covered, ["story_id"], [F.col("fetched_at").desc(), F.col("content_sha256").desc()]).select("story_id", "themes")
    on = newest.join(stories.select("story_id", *[F.array_contains("surfaces", s).cast("int").alias(s) for s in SURFACES]), "story_id")
    each = on.select(*SURFACES, F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.filter("themes", lambda t: t.isNotNull()), F.array().cast("array<string>")))).alias("theme"))
    n = each.groupBy("theme").agg(*[F.sum(s).alias(s) for s in SURFACES])
    totals = n.where("theme is null").select(F.struct(*SURFACES)).scalar()
    t = n.where("theme is not null").where(F.col("front_page") + F.col("most_read") >= support).withColumn("all", totals)
    f, m = percent(F.col("front_page"), F.col("all.front_page")), percent(F.col("most_read"), F.col("all.most_read"))
    return t.select("theme", F.round(f, 2).alias("front_page_share"), F.round(m, 2).alias("most_read_share"), F.round(m - f, 2).alias("difference_points"))


def surface_differences(themes: DataFrame, most: int = 10) -> DataFrame:
    return themes.orderBy(F.abs("difference_points").desc(), "theme").limit(most)


def coverage(articles: DataFrame, signals: DataFrame) -> DataFrame:
    """Different good versions, those with labels, and their share."""
    a = unique_articles(articles).select("content_sha256")
    s = signals.select("content_sha256").distinct().withColumn("has", F.lit(1))
    n = a.join(s, "content_sha256", "left").agg(F.count("*").alias("versions"), F.count("has").alias("labelled_versions"))
    return n.withColumn("coverage_percent", F.round(percent(F.col("labelled_versions"), F.col("versions")), 1))


def _most_common(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """``key, items``: the ``k`` most frequent values in order, equal ones by their first row in (fetched_at, content)."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(F.struct("fetched_at", "content_sha256", "ord")).alias("seen"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), "seen")
    top = n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", F.col(value).alias("v")))).alias("i")).select(key, F.transform("i", lambda x: x["v"]).alias("items"))


def recurring_stories(events: DataFrame, stories: DataFrame) -> DataFrame:
    """Clusters of at least two stories: label, type, top themes, span, counts, and the newest version of each story in order (A13-A15, J5, T-8, N8)."""
    e = latest_by(events.where("cluster_size > 1"), ["cluster_id", "content_sha256"], [F.col("fetched_at").desc(), F.xxhash64("event_label", "event_type", "title").desc()]).withColumn("ord", F.lit(0))
    versions = latest_by(e, ["cluster_id", "story_id"], [F.col("fetched_at").desc(), F.col("content_sha256").desc()])
    st = stories.select("story_id", "observation_count", "surfaces")
    article = F.struct("fetched_at", "story_id", "title", F.col("canonical_url").alias("url"), F.coalesce("observation_count", F.lit(0)).alias("observation_count"), F.coalesce("surfaces", F.array().cast("array<string>")).alias("surfaces"))
    nested = versions.join(st, "story_id", "left").groupBy("cluster_id").agg(F.array_sort(F.collect_list(article)).alias("articles"), F.count("*").alias("article_count")).where("article_count >= 2")
    span = e.groupBy("cluster_id").agg(F.min("fetched_at").alias("first_seen"), F.max("fetched_at").alias("last_seen"), F.count("*").alias("version_count"))
    label = _most_common(e, "cluster_id", "event_label", 1).select("cluster_id", F.col("items")[0].alias("label"))
    kind = _most_common(e, "cluster_id", "event_type", 1).select("cluster_id", F.col("items")[0].alias("event_type"))
    each = e.select("cluster_id", "fetched_at", "content_sha256", F.posexplode("themes").alias("ord", "theme"))
    themes = _most_common(each, "cluster_id", "theme", 5).select("cluster_id", F.col("items").alias("themes"))
    out = nested.join(span, "cluster_id").join(label, "cluster_id").join(kind, "cluster_id").join(themes, "cluster_id", "left")
    return out.select("cluster_id", "label", "event_type", F.coalesce("themes", F.array().cast("array<string>")).alias("themes"), "first_seen", "last_seen", "article_count", "version_count", "articles")


def returning_stories(recurring: DataFrame, most: int = 8) -> DataFrame:
    return recurring.drop("articles").orderBy(F.col("article_count").desc(), F.col("version_count").desc(), F.col("last_seen").desc(), "cluster_id").limit(most)


def event_page(recurring: DataFrame, text: str = "", page: int = 0, size: int = 40) -> DataFrame:
    """A page of clusters, newest first, whose label, type or themes hold ``text`` (P11, P13, T-14). Pages beyond the last are the last."""
    low = F.lower(F.concat_ws(" ", "label", "event_type", F.array_join("themes", " ")))
    hit = recurring.where(F.contains(low, F.lit(text.lower()))).select("cluster_id", "label", "event_type", "last_seen", "article_count", "version_count")
    at = max(page, 0)
    if at:  # the first page exists however few there are
        at = min(at, max(0, -(-hit.count() // size) - 1))
    return hit.orderBy(F.col("last_seen").desc(), F.col("article_count").desc(), "cluster_id").offset(at * size).limit(size)


def story_page(stories: DataFrame, text: str = "", surface: str = "all", order: str = "last_seen", page: int = 0, size: int = 15) -> DataFrame:
    """A page of stories by title and surface in one of three orders (P10, T-15)."""
    rows = stories.where(F.contains(F.lower("title"), F.lit(text.lower())))
    if surface != "all":
        rows = rows.where(F.array_contains("surfaces", surface))
    by: dict[str, Column] = {"last_seen": F.col("last_seen").desc(), "observation_count": F.col("observation_count").desc(), "best_position": F.col("best_position").asc()}
    return rows.orderBy(by[order], "story_id").offset(page * size).limit(size)


def semantic_index(articles: DataFrame, signals: DataFrame, embeddings: DataFrame, stories: DataFrame, dim: int = 384) -> DataFrame:
    """One document per story that has a vector: newest embedded version, labels and statistics with defaults, and its quantised vector."""
    e = embeddings.where((F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0))
    e = latest_by(e, ["content_sha256"], [F.col("generated_at").desc(), F.xxhash64("embedding").desc()]).select("content_sha256", "embedding")
    a = unique_articles(articles).select("content_sha256", "story_id", "canonical_url", "title", "fetched_at")
    newest = latest_by(a.join(e.select("content_sha256"), "content_sha256", "left_semi"), ["story_id"], [F.col("fetched_at").desc(), F.col("content_sha256").desc()])
    s = newest_signals(signals).select("content_sha256", "topic", "themes", "summary", "event_type", "story_form")
    st = stories.select("story_id", "observation_count", "best_position", "surfaces")
    doc = newest.join(e, "content_sha256").join(s, "content_sha256", "left").join(st, "story_id", "left").withColumn("v", quantized(F.col("embedding")))
    words = lambda c: or_default(F.col(c), "unlabelled").alias(c)
    none = F.array().cast("array<string>")
    return doc.select(
        "story_id", "content_sha256", or_default(F.col("title"), "Untitled").alias("title"), F.col("canonical_url").alias("url"), "fetched_at", F.coalesce("summary", F.lit("")).alias("summary"), words("topic"),
        F.coalesce("themes", none).alias("themes"), words("event_type"), words("story_form"), F.coalesce("observation_count", F.lit(0)).alias("observation_count"), "best_position", F.coalesce("surfaces", none).alias("surfaces"),
        F.col("v.q").alias("vector"), F.col("v.scale").alias("scale"), F.col("v.norm").alias("norm"),
    )


def facets(index: DataFrame) -> DataFrame:
    """``facet, value``: different topics and story forms."""
    return index.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("topic", "story_form")])).alias("x")).select("x.*").distinct()


def run_summary(observations: DataFrame) -> DataFrame:
    """Rows of each surface per run."""
    return observations.groupBy("scrape_id").agg(*[F.count_if(F.col("surface") == s).alias(f"{s}_count") for s in SURFACES])


def first_seen(observations: DataFrame, key: str = "url") -> DataFrame:
    return observations.groupBy(key).agg(F.min("observed_at").alias("first_observed_at"))


def completed_days(observations: DataFrame, today: Column | None = None, most: int = 120) -> DataFrame:
    """``observed_date, rows`` of the last days that are over: before ``today``, or without it before the last day observed."""
    o = observations.select(F.to_date("observed_at").alias("observed_date"))
    before = today if today is not None else o.agg(F.max("observed_date")).scalar()
    return o.where(F.col("observed_date") < before).groupBy("observed_date").agg(F.count("*").alias("rows")).orderBy(F.col("observed_date").desc()).limit(most)


def story_points(observations: DataFrame) -> DataFrame:
    """The places of each story over time, for its chart."""
    return observations.select("story_id", "observed_at", "surface", "position")


def findings_window(covered: DataFrame, days: int = 14) -> DataFrame:
    """``versions, recent_from, recent_to, previous_from, previous_to``: the days that momentum compares; null where nothing is labelled."""
    w = covered.agg(F.count("*").alias("versions"), F.max(F.to_date("fetched_at")).alias("recent_to"))
    day = lambda back: F.date_sub("recent_to", back)
    return w.select("versions", day(days - 1).alias("recent_from"), "recent_to", day(2 * days - 1).alias("previous_from"), day(days).alias("previous_to"))


def build_marts(observations: DataFrame, articles: DataFrame | None = None, signals: DataFrame | None = None, embeddings: DataFrame | None = None, events: DataFrame | None = None) -> dict[str, DataFrame]:
    """All marts in their order and a manifest of their rows.

    All inputs but the observations are optional: marts of one that is missing are empty, and the window of findings is null.
    """
    spark = observations.sparkSession
    given = {"article_snapshots": articles, "story_signals": signals, "article_embeddings": embeddings, "recurring_events": events}
    articles, signals, embeddings, events = (spark.createDataFrame([], schemas.TABLES[n]) if df is None else df for n, df in given.items())
    stories = story_stats(observations)
    covered = labelled(articles, signals)
    momentum = theme_momentum(covered)
    recurring = recurring_stories(events, stories)
    marts = {
        "stories": stories, "rank_series": rank_series(observations), "daily": daily_surfaces(observations), "lag": surface_lag(observations), "trends": trend_cube(covered),
        "rising_themes": rising(momentum), "falling_themes": falling(momentum), "story_forms": form_shares(covered), "surface_differences": surface_differences(surface_themes(covered, stories)),
        "findings_window": findings_window(covered), "coverage": coverage(articles, signals), "recurring": recurring, "returning": returning_stories(recurring), "semantic_index": semantic_index(articles, signals, embeddings, stories),
    }
    manifest = None
    for name, mart in marts.items():
        one = mart.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        manifest = one if manifest is None else manifest.unionByName(one)
    return {n: ordered(n, m) for n, m in marts.items()} | {"manifest": manifest}


def write_marts(marts: dict[str, DataFrame], root: str) -> None:
    """Each mart below ``root``: the index with its vectors as Parquet, all others as JSON lines."""
    for name, mart in marts.items():
        if name == "semantic_index":
            write_table(mart, f"{root}/{name}", mode="overwrite")
        else:
            write_json(mart, f"{root}/{name}")
