"""Canonical relations of the data folder: each key once, times in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.functions.text import millis
from reelspan.runtime import read


def latest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row for each key: of rows that repeat it, the one greatest in ``version`` and then in its other columns.

    One shuffle with partial aggregation; a key that is repeated a billion times costs one row a task.
    """
    rest = [c for c in df.columns if c not in key and c != version]
    ordered = [c for c in rest if "map<" not in dict(df.dtypes)[c]]
    best = df.groupBy(*key).agg(F.max_by(F.struct(version, *rest), F.struct(version, *ordered)).alias("_x"))
    return best.select(*key, *[F.col(f"_x.{c}").alias(c) for c in df.columns if c not in key])


def segments(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """``video_id, id, start_ms, end_ms, source_text, target_text, *extra``, each segment once, the latest delivery."""
    df = latest(read(spark, sf_dir, "segments", "video_id", "id", "start_s", "end_s", "source_text", "target_text", *extra, "ingested_at"), ["video_id", "id"], "ingested_at")
    return df.select("video_id", "id", millis(F.col("start_s")).alias("start_ms"), millis(F.col("end_s")).alias("end_ms"), "source_text", "target_text", *extra)


def cues(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """``video_id, cue_id, start_ms, end_ms, en_text, zh_text, source_segment_id, *extra``, each cue once."""
    df = latest(read(spark, sf_dir, "display_cues", "video_id", "cue_id", "start_s", "end_s", "en_text", "zh_text", "source_segment_id", *extra, "updated_at"), ["video_id", "cue_id"], "updated_at")
    return df.select("video_id", "cue_id", millis(F.col("start_s")).alias("start_ms"), millis(F.col("end_s")).alias("end_ms"), "en_text", "zh_text", "source_segment_id", *extra)


def timed(df: DataFrame) -> DataFrame:
    """Rows with a start, and an end after it."""
    return df.where("start_ms IS NOT NULL AND end_ms IS NOT NULL AND end_ms > start_ms")


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual lines: ``video_id, dialogue_id, layer, start_ms, end_ms, style, text``."""
    df = read(spark, sf_dir, "ass_dialogues").select("video_id", "dialogue_id", "layer", millis(F.col("start_s")).alias("start_ms"), millis(F.col("end_s")).alias("end_ms"), "style", "text")
    return df.dropDuplicates(["dialogue_id"])


def clean_dialogue(text: Column) -> Column:
    """A manual line without override tags, its line breaks as spaces, folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\{[^}]*\}", ""), r"\\[Nnh]", " "), r"\s+", " "))


#: The same relations for DuckDB, as common table expressions.
SEGMENTS_SQL = """seg AS (SELECT video_id, id, CAST(round(start_s * 1000) AS BIGINT) AS start_ms, CAST(round(end_s * 1000) AS BIGINT) AS end_ms, source_text, target_text, words, confidence, source
  FROM (SELECT *, row_number() OVER (PARTITION BY video_id, id ORDER BY ingested_at DESC) AS _k FROM segments) WHERE _k = 1)"""
CUES_SQL = """cue AS (SELECT video_id, cue_id, CAST(round(start_s * 1000) AS BIGINT) AS start_ms, CAST(round(end_s * 1000) AS BIGINT) AS end_ms, en_text, zh_text, source_segment_id, group_index, group_total, rewrite_action
  FROM (SELECT *, row_number() OVER (PARTITION BY video_id, cue_id ORDER BY updated_at DESC) AS _k FROM display_cues) WHERE _k = 1)"""
DIALOGUES_SQL = r"""dlg AS (SELECT DISTINCT video_id, dialogue_id, layer, CAST(round(start_s * 1000) AS BIGINT) AS start_ms, CAST(round(end_s * 1000) AS BIGINT) AS end_ms, style, text,
  trim(regexp_replace(regexp_replace(regexp_replace(text, '\{[^}]*\}', '', 'g'), '\\[Nnh]', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM ass_dialogues)"""
