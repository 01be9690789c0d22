"""Queries on time intervals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.functions.text import millis
from reelspan.operators.intervals import merge_intervals, periods_and_gaps
from reelspan.runtime import read


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods and gaps of each video, on the segment axis and on the cue axis."""
    def axis(name: str, table: str, key: str, version: str) -> DataFrame:
        df = read(spark, sf_dir, table, "video_id", key, "start_s", "end_s", version)
        return df.select(F.lit(name).alias("axis"), "video_id", F.col(key).alias("row_id"), millis(F.col("start_s")).alias("start_ms"), millis(F.col("end_s")).alias("end_ms"), F.col(version).alias("version"))

    rows = axis("segment", "segments", "id", "ingested_at").unionByName(axis("cue", "display_cues", "cue_id", "updated_at"))
    merged = merge_intervals(rows, ["axis", "video_id"], "row_id", version="version")
    return periods_and_gaps(merged, ["axis", "video_id"]).select("axis", "video_id", "kind", "start_ms", "end_ms")


P2_SQL = """
WITH raw AS (
  SELECT 'segment' AS axis, video_id, id AS row_id, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e, ingested_at AS v FROM segments
  UNION ALL
  SELECT 'cue', video_id, cue_id, CAST(round(start_s * 1000) AS BIGINT), CAST(round(end_s * 1000) AS BIGINT), updated_at FROM display_cues),
one AS (SELECT axis, video_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY axis, video_id, row_id ORDER BY v DESC NULLS LAST, s DESC NULLS LAST, e DESC NULLS LAST) AS k FROM raw) WHERE k = 1 AND e > s),
marked AS (SELECT *, max(e) OVER (PARTITION BY axis, video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM one),
numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY axis, video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
stretch AS (SELECT axis, video_id, island, min(s) AS s, max(e) AS e, count(*) AS n FROM numbered GROUP BY 1, 2, 3),
gap AS (SELECT axis, video_id, lag(e) OVER (PARTITION BY axis, video_id ORDER BY s) AS s, s AS e FROM stretch)
SELECT axis, video_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM stretch WHERE n >= 2
UNION ALL SELECT axis, video_id, 'gap', s, e FROM gap WHERE e - s >= 1500
"""

QUERIES = {"p2_found": p2_found}
SQL = {"p2_found": P2_SQL}
