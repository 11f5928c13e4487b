"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.clusters import cluster_vectors
from quillspark.llm.mainbody import story_blocks
from quillspark.llm.mixing import select_mix, share_report
from quillspark.llm.names import link_names, name_pairs
from quillspark.llm.neighbours import nearest
from quillspark.llm.packing import fill_report, pack
from quillspark.llm.residue import find_residue
from quillspark.llm.runs import collapse_runs
from quillspark.llm.sentences import sentences
from quillspark.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return collapse_runs(table(spark, folder, "observations")).where("observations >= 2").select("story_id", "surface", "started_us", "ended_us")


def p1_runs(spark: SparkSession, folder: str) -> DataFrame:
    return collapse_runs(table(spark, folder, "observations"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return name_pairs(table(spark, folder, "story_signals"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return link_names(table(spark, folder, "story_signals"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_vectors(table(spark, folder, "article_embeddings")).where("group_size >= 2").select("content_sha256", "group_key")


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_vectors(table(spark, folder, "article_embeddings"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    snapshots = table(spark, folder, "article_snapshots")
    residue = find_residue(snapshots).where("residue").select("snapshot_id")
    return story_blocks(snapshots, table(spark, folder, "raw_article_snapshots"), residue).select("snapshot_id", "block_key")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    n = nearest(table(spark, folder, "article_embeddings"))
    a, b = F.col("content_sha256"), F.col("neighbour_sha256")
    return n.select(F.least(a, b).alias("sha_a"), F.greatest(a, b).alias("sha_b")).distinct()


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "article_embeddings")).withColumn("similarity", F.round("similarity", 6))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_residue(table(spark, folder, "article_snapshots")).where("residue").select("snapshot_id")


def p6_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return find_residue(table(spark, folder, "article_snapshots"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), table(spark, folder, "pack_plans"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    plans = table(spark, folder, "pack_plans")
    return fill_report(pack(table(spark, folder, "documents"), plans), plans)


def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    return select_mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return share_report(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(table(spark, folder, "documents")).select("doc_id", "sent_start", "sent_end")


_RUNS_SQL = """
WITH RECURSIVE o AS (
  SELECT story_id, surface, epoch_us(observed_at) AS us, min(position)::INT AS p FROM observations
  WHERE story_id IS NOT NULL AND surface IS NOT NULL AND observed_at IS NOT NULL AND position IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY story_id, surface ORDER BY us) AS i FROM o),
g AS (
  SELECT story_id, surface, i, us, p, p AS anchor, us AS start FROM r WHERE i = 1
  UNION ALL
  SELECT r.story_id, r.surface, r.i, r.us, r.p,
         CASE WHEN abs(r.p - g.anchor) <= 1 AND r.us - g.us <= 3600000000 THEN g.anchor ELSE r.p END,
         CASE WHEN abs(r.p - g.anchor) <= 1 AND r.us - g.us <= 3600000000 THEN g.start ELSE r.us END
  FROM g JOIN r ON r.story_id = g.story_id AND r.surface = g.surface AND r.i = g.i + 1),
runs AS (
  SELECT story_id, surface, start AS started_us, max(us) AS ended_us, count(*) AS observations, max(us) - start AS duration_us, min(anchor) AS anchor
  FROM g GROUP BY story_id, surface, start)
"""

_SIMILAR_SQL = """
WITH RECURSIVE u AS (
  SELECT content_sha256 AS sha, embedding::DOUBLE[] AS e FROM article_embeddings
  WHERE content_sha256 IS NOT NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  QUALIFY row_number() OVER (PARTITION BY content_sha256 ORDER BY generated_at DESC NULLS LAST) = 1),
pairs AS (
  SELECT a.sha AS a, b.sha AS b, round(list_cosine_similarity(a.e, b.e), 12) AS s FROM u a JOIN u b ON a.sha < b.sha
  WHERE list_cosine_similarity(a.e, b.e) >= 0.78),
links AS (SELECT a, b, s FROM pairs UNION ALL SELECT b, a, s FROM pairs),
"""

QUERIES = {"p1_found": p1_found, "p1_runs": p1_runs, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_clusters": p3_clusters, "p4_found": p4_found, "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p6_found": p6_found, "p6_evidence": p6_evidence, "p8_packed": p8_packed, "p8_fill": p8_fill, "p9_selection": p9_selection, "p9_shares": p9_shares, "p10_found": p10_found}
SQL = {
    "p1_found": _RUNS_SQL + "SELECT story_id, surface, started_us, ended_us FROM runs WHERE observations >= 2",
    "p3_found": _SIMILAR_SQL
    + """reach AS (SELECT a, a AS r FROM links UNION SELECT links.b, reach.r FROM reach JOIN links USING (a))
SELECT a AS content_sha256, min(r) AS group_key FROM reach GROUP BY a""",
    "p5_found": _SIMILAR_SQL
    + """best AS (SELECT a, b FROM links QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS sha_a, greatest(a, b) AS sha_b FROM best""",
    "p5_neighbours": _SIMILAR_SQL
    + """best AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS place FROM links)
SELECT a AS content_sha256, b AS neighbour_sha256, round(s, 6) AS similarity, place FROM best WHERE place <= 5""",
    "p1_runs": _RUNS_SQL + "SELECT * FROM runs",
}
