"""Queries on matches between relations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan import tables as T
from reelspan.operators import matching as M
from reelspan.runtime import read


def reconciled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments without a cue, and segments that only cues name, of the videos that have cues."""
    cues = T.cues(spark, sf_dir).where("source_segment_id IS NOT NULL")
    expected = T.segments(spark, sf_dir).select("video_id", "id").join(cues.select("video_id").distinct(), "video_id", "left_semi")
    return M.reconcile(expected, cues.select("video_id", F.col("source_segment_id").alias("id")), ["video_id", "id"])


def lines_over_broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual Chinese lines above a source line of two lines."""
    return M.lines_over_broken_lines(T.dialogues(spark, sf_dir)).select("video_id", "dialogue_id")


def description_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, mentions and hosts in documents, and how many documents have each."""
    rows = read(spark, sf_dir, "documents", "doc_id", "text").select(F.explode(M.description_terms(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n_documents"))


def effective_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity rules with glossary entries of the same name put over them."""
    rules = read(spark, sf_dir, "entity_rules").select(F.lower("canonical_en").alias("name"), F.col("canonical_zh").alias("zh"), "policy", "entity_type")
    terms = read(spark, sf_dir, "glossary_terms").select(F.lower("canonical").alias("name"), "zh", "policy")
    return M.overridden(rules, terms, "name")


QUERIES = {f.__name__: f for f in (reconciled_segments, lines_over_broken_lines, description_terms, effective_entities)}

SQL = {
    "reconciled_segments": f"""WITH {T.SEGMENTS_SQL}, {T.CUES_SQL}, c AS (SELECT DISTINCT video_id, source_segment_id AS id FROM cue WHERE source_segment_id IS NOT NULL), s AS (SELECT DISTINCT video_id, id FROM seg WHERE video_id IN (SELECT video_id FROM c))
SELECT coalesce(s.video_id, c.video_id) AS video_id, coalesce(s.id, c.id) AS id, CASE WHEN c.id IS NULL THEN 'missing' ELSE 'extra' END AS status FROM s FULL JOIN c ON s.video_id = c.video_id AND s.id = c.id WHERE s.id IS NULL OR c.id IS NULL""",
    "lines_over_broken_lines": rf"WITH {T.DIALOGUES_SQL} SELECT video_id, dialogue_id FROM dlg a WHERE layer = 0 AND EXISTS (SELECT 1 FROM dlg b WHERE b.layer = 1 AND contains(b.text, '\N') AND a.video_id = b.video_id AND a.start_ms = b.start_ms AND a.end_ms = b.end_ms)",
    "description_terms": """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), x AS (SELECT doc_id, unnest(list_distinct(list_concat(list_transform(regexp_extract_all(t, '#([a-z0-9_]+)', 1), lambda v: 'tag:' || v), list_transform(regexp_extract_all(t, '@([a-z0-9_]+)', 1), lambda v: 'mention:' || v), list_transform(regexp_extract_all(t, 'https?://([a-z0-9.-]+)', 1), lambda v: 'host:' || v)))) AS term FROM d)
SELECT term, count(*) AS n_documents FROM x GROUP BY 1""",
    "effective_entities": "SELECT coalesce(lower(t.canonical), lower(e.canonical_en)) AS name, coalesce(t.zh, e.canonical_zh) AS zh, coalesce(t.policy, e.policy) AS policy, e.entity_type FROM entity_rules e FULL JOIN glossary_terms t ON lower(e.canonical_en) = lower(t.canonical)",
}
