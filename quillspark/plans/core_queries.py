"""Queries over the general operators that deal with training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators.snapshot_diff import list_changes
from quillspark.sources.tables import table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return list_changes(table(spark, folder, "observations"), table(spark, folder, "scrape_runs"))


P7_FOUND_SQL = """
WITH ok AS (
  SELECT scrape_id FROM (
    SELECT scrape_id, success, row_number() OVER (PARTITION BY scrape_id ORDER BY completed_at DESC NULLS LAST, started_at DESC NULLS LAST, success DESC) AS rn
    FROM scrape_runs) WHERE rn = 1 AND success),
o AS (
  SELECT scrape_id, surface, story_id, min(position) AS position, min(observed_at) AS observed_at
  FROM observations JOIN ok USING (scrape_id)
  WHERE surface IS NOT NULL AND story_id IS NOT NULL AND observed_at IS NOT NULL GROUP BY ALL),
s AS (SELECT scrape_id, min(observed_at) AS seen FROM o GROUP BY scrape_id),
p AS (
  SELECT * FROM (
    SELECT scrape_id, seen, lag(scrape_id) OVER w AS prev, lag(seen) OVER w AS prev_seen FROM s WINDOW w AS (ORDER BY seen, scrape_id))
  WHERE prev IS NOT NULL AND seen - prev_seen <= INTERVAL 6 HOURS),
a AS (SELECT p.scrape_id, surface, story_id, position FROM p JOIN o USING (scrape_id)),
b AS (SELECT p.scrape_id, surface, story_id, position FROM p JOIN o ON o.scrape_id = p.prev)
SELECT scrape_id, surface, story_id,
       CASE WHEN b.position IS NULL THEN 'added' WHEN a.position IS NULL THEN 'removed' ELSE 'moved' END AS change
FROM a FULL JOIN b USING (scrape_id, surface, story_id)
WHERE a.position IS DISTINCT FROM b.position
"""

QUERIES = {"p7_found": p7_found}
SQL = {"p7_found": P7_FOUND_SQL}
