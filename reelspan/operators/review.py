"""Rows for a reviewer: what is wrong with cues and segments, the worst first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.functions import rules as R


def display_issues(cues: DataFrame, *, line_chars: int = 28, lines: int = 2, soft_chars: int = 33, hard_chars: int = 36, soft_cps: float = 18.0, hard_cps: float = 22.0) -> DataFrame:
    """``video_id, cue_id, n_lines, line_length, cps_hundredths, issues`` of timed cues with a Chinese text that is too long or too fast.

    A text of more than one line's signs takes as many even lines as it needs, up to ``lines``.
    """
    n = R.visible_length(F.col("zh_text"))
    rows = cues.where(n > 0).withColumn("_n", n).withColumn("_want", F.ceil(n / line_chars).cast("int")).withColumn("n_lines", F.least(F.col("_want"), F.lit(lines)))
    rows = rows.withColumn("line_length", F.ceil(F.col("_n") / F.col("n_lines")).cast("int")).withColumn("_cps", F.col("_n") * 1000 / F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1)))
    issues = F.array_compact(F.array(
        F.when(F.col("_want") > lines, "too_many_lines"), F.when(F.col("line_length") > hard_chars, "line_too_long_hard").when(F.col("line_length") > soft_chars, "line_too_long_soft"),
        F.when(F.col("_cps") > hard_cps, "cps_high_hard").when(F.col("_cps") > soft_cps, "cps_high_soft"),
    ))
    return rows.withColumn("issues", issues).where(F.size("issues") > 0).select("video_id", "cue_id", "n_lines", "line_length", F.floor(F.col("_cps") * 100).cast("bigint").alias("cps_hundredths"), F.array_join("issues", ",").alias("issues"))


def editor_rows(feeds: list[DataFrame]) -> DataFrame:
    """``video_id, id, risk_type, severity, score, feed``: findings of several feeds (``video_id, id, risk_type, severity, score``), each kind once a segment: the first feed that has it wins.

    A minimum with partial aggregation, so a segment or kind with a third of the rows is no one task.
    """
    every = reduce(DataFrame.unionByName, [f.select("video_id", "id", "risk_type", "severity", F.col("score").cast("bigint").alias("score")).withColumn("feed", F.lit(k)) for k, f in enumerate(feeds, 1)])
    best = every.groupBy("video_id", "id", "risk_type").agg(F.min(F.struct("feed", (-F.col("score")).alias("minus"), "severity")).alias("x"))
    return best.select("video_id", "id", "risk_type", "x.severity", (-F.col("x.minus")).alias("score"), "x.feed")
