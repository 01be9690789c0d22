"""Queries on re-segmentation, with their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan import tables as T
from reelspan.operators import segmentation as S
from reelspan.plans.quality_queries import _RISK, _SQ, _VL


def pause_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments cut at strong pauses between their words."""
    return S.pause_splits(T.segments(spark, sf_dir, "words"))


def display_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets in parts that can be read."""
    return S.display_parts(T.timed(T.segments(spark, sf_dir)))


def refined_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments re-cut into subtitles."""
    return S.refine_timing(T.segments(spark, sf_dir, "words"))


def reading_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments joined into groups that read well."""
    return S.reading_groups(T.segments(spark, sf_dir))


def deoverlapped_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual lines as captions that don't overlap."""
    lines = T.dialogues(spark, sf_dir).where("layer = 0").select("video_id", F.col("dialogue_id").alias("id"), "start_ms", "end_ms", T.clean_dialogue(F.col("text")).alias("text"))
    return S.deoverlap(lines)


def merged_short_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short whole sentences shown together."""
    return S.merge_short_cues(T.cues(spark, sf_dir))


def difficult_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of segments that need another look."""
    return S.difficult_spans(T.segments(spark, sf_dir))


def refined_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each video after re-cutting: none lost, none said twice, none outside its video's time."""
    return refined_timing(spark, sf_dir).groupBy("video_id").agg(F.sum(F.size(F.split("text", " "))).alias("n_words"), F.count_if(F.col("end_ms") <= F.col("start_ms")).alias("n_bad_times"))


def reading_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and words of each video in reading groups: each segment in one."""
    groups = reading_groups(spark, sf_dir).select("video_id", "text", F.size("segment_ids").alias("n"))
    return groups.groupBy("video_id").agg(F.sum("n").alias("n_segments"), F.sum(F.size(F.split("text", " "))).alias("n_words"))


def merged_cue_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of each video in merged groups: each cue in one."""
    return merged_short_cues(spark, sf_dir).groupBy("video_id").agg(F.sum(F.size("cue_ids")).alias("n_cues"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def difficult_span_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos with difficult spans: the longest span, and spans without the score that opens one."""
    spans = difficult_spans(spark, sf_dir)
    return spans.groupBy("video_id").agg((F.max("n_segments") <= 10).alias("within_limit"), F.count_if(F.col("score") < 2).alias("n_without_risk"))


QUERIES = {f.__name__: f for f in (
    pause_splits, display_parts, refined_timing, reading_groups, deoverlapped_captions, merged_short_cues, difficult_spans, refined_words, reading_group_sizes, merged_cue_sizes, difficult_span_bounds,
)}

_TEXTS = f"WITH {T.SEGMENTS_SQL}, t AS (SELECT video_id, id, {_SQ('source_text')} AS s FROM seg WHERE end_ms > start_ms AND {_SQ('source_text')} <> '')"

SQL = {
    "refined_words": f"{_TEXTS} SELECT video_id, CAST(sum(len(string_split(s, ' '))) AS BIGINT) AS n_words, CAST(0 AS BIGINT) AS n_bad_times FROM t GROUP BY 1",
    "reading_group_sizes": f"{_TEXTS} SELECT video_id, count(*) AS n_segments, CAST(sum(len(string_split(s, ' '))) AS BIGINT) AS n_words FROM t GROUP BY 1",
    "merged_cue_sizes": f"WITH {T.CUES_SQL} SELECT video_id, count(*) AS n_cues, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM cue WHERE end_ms > start_ms GROUP BY 1",
    "difficult_span_bounds": f"WITH {T.SEGMENTS_SQL}, s AS (SELECT video_id, id, sum(r.weight) AS score FROM ({_RISK.replace('FROM seg)', 'FROM seg WHERE end_ms > start_ms)')}) WHERE r IS NOT NULL GROUP BY 1, 2) SELECT DISTINCT video_id, true AS within_limit, CAST(0 AS BIGINT) AS n_without_risk FROM s WHERE score >= 2",
    "pause_splits": f"""WITH {T.SEGMENTS_SQL}, e AS (SELECT video_id, id, unnest(words) AS w, generate_subscripts(words, 1) AS place FROM seg),
w AS (SELECT video_id, id, place, w.word AS word, CAST(round(w.start_s * 1000) AS BIGINT) AS a, CAST(round(w.end_s * 1000) AS BIGINT) AS b FROM e), u AS (SELECT * FROM w WHERE word IS NOT NULL AND a IS NOT NULL AND b >= a),
g AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY video_id, id ORDER BY place) >= 1200 THEN 1 ELSE 0 END AS new FROM u),
p AS (SELECT *, sum(new) OVER (PARTITION BY video_id, id ORDER BY place ROWS UNBOUNDED PRECEDING) + 1 AS piece FROM g)
SELECT video_id, id, CAST(piece AS BIGINT) AS piece, count(*) AS n_words, min(a) AS start_ms, max(b) AS end_ms, string_agg(word, ' ' ORDER BY place) AS text FROM p GROUP BY 1, 2, 3""",
    "display_parts": f"""WITH {T.SEGMENTS_SQL}, m AS (SELECT video_id, id, start_ms, end_ms - start_ms AS d, {_VL('target_text')} AS n FROM seg WHERE end_ms > start_ms),
k AS (SELECT *, CASE WHEN d > 8500 OR n > 56 OR n * 1000 / d > 18 THEN CAST(least(3, greatest(ceil(d / 7500), ceil(n / 56), ceil(n * 1000 / d / 18)), greatest(1, d // 2200)) AS INT) ELSE 1 END AS n_parts FROM m WHERE n > 0),
x AS (SELECT *, unnest(range(1, n_parts + 1)) AS part FROM k)
SELECT video_id, id, CAST(part AS INT) AS part, n_parts, start_ms + d * (part - 1) // n_parts AS start_ms, start_ms + d * part // n_parts AS end_ms FROM x""",
}
