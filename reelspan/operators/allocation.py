"""How translations fall on segments: flags, confidence, and checks of a translation against its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions import rules as R
from reelspan.functions import wording as W
from reelspan.operators.sequences import running_last


def allocation_flags(source: Column, target: Column, span_segments: Column) -> Column:
    """Names of what is doubtful in a segment's translation, an array; an empty target has just that."""
    s, t = R.squash(source), R.squash(target)
    found = F.array(
        F.when(~R.has_chinese(t) & s.rlike("[A-Za-z]"), "target_without_chinese"), F.when(t.rlike("(" + "|".join(W.OPEN_ALLOCATION_ENDS) + ")$"), "target_open_ending"),
        F.when((R.visible_length(t) <= 3) & (R.visible_length(s) >= 18), "target_too_short"), F.when(R.leaves_marker(t), "short_english_leak"),
        F.when((W.sentence_count(s) >= 2) & (F.size(W.meaning_chunks(t)) >= 2), "possible_two_sentence_target"),
        F.when((span_segments >= 2) & ~R.ends_sentence(s) & t.rlike("[。！？]$"), "closed_translation_for_open_source"),
    )
    return F.when(t == "", F.array(F.lit("empty_target"))).otherwise(F.array_compact(found))


def allocation(segments: DataFrame, spans: DataFrame, *, most_spans: int = 16) -> DataFrame:
    """``video_id, id, start_ms, end_ms, span_segments, flags, confidence, status``.

    ``spans``: ``video_id, span, segment_ids, n_segments, risk_score, start_id``. Of each video the ``most_spans`` spans of
    highest score count (that bound is the rule; 0 takes all), found by an aggregation that keeps no more. Confidence is 0.76 less 0.12 a flag, 0.05 at
    least; from 0.58 a target is applied. A target equal to the last one said in its video is flagged too.
    """
    if most_spans > 0:
        row = F.struct((-F.col("risk_score")).alias("o"), "start_id", "span", "segment_ids", "n_segments")
        spans = spans.groupBy("video_id").agg(F.slice(F.array_sort(F.collect_list(row)), 1, most_spans).alias("_s")).select("video_id", F.explode("_s").alias("s")).select("video_id", "s.*")
    of = spans.select("video_id", F.explode("segment_ids").alias("id"), F.col("n_segments").alias("span_segments"))
    rows = segments.join(of, ["video_id", "id"], "left").withColumn("span_segments", F.coalesce("span_segments", F.lit(1)))
    text = F.when(R.squash(F.col("target_text")) != "", R.squash(F.col("target_text")))
    rows = running_last(rows, ["video_id"], text, "_last")
    flags = allocation_flags(F.col("source_text"), F.col("target_text"), F.col("span_segments"))
    flags = F.array_sort(F.concat(flags, F.when(F.coalesce(text == F.col("_last"), F.lit(False)), F.array(F.lit("adjacent_duplicate_target"))).otherwise(F.array().cast("array<string>"))))
    rows = rows.withColumn("flags", flags).withColumn("confidence", F.round(F.greatest(F.lit(0.05), F.lit(0.76) - F.least(F.lit(0.55), F.lit(0.12) * F.size("flags"))), 2))
    status = F.when((R.squash(F.col("target_text")) != "") & (F.col("confidence") >= 0.58), "applied").otherwise("review")
    return rows.select("video_id", "id", "start_ms", "end_ms", F.col("span_segments").cast("bigint").alias("span_segments"), "flags", "confidence", status.alias("status"))


def translation_issues(expected: DataFrame, returned: DataFrame, key: list[str]) -> DataFrame:
    """``*key, issue`` of returned translations (``target``) against what was asked for (``source``).

    missing, extra, empty, source_echo, target_without_chinese, text_pollution, short_english_leak. One full outer join; a
    translation whose source has nothing to translate may repeat it or have no Chinese.
    """
    both = expected.select(*key, F.col("source"), F.lit(True).alias("_asked")).join(returned.select(*key, F.col("target"), F.lit(True).alias("_given")), key, "full")
    s, t = R.squash(F.col("source")), R.squash(F.col("target"))
    asked, given = F.col("_asked").isNotNull(), F.col("_given").isNotNull()
    said = asked & given & (t != "")
    same = F.lower(F.regexp_replace(s, r"[\p{P}\p{S}\p{Z}\s]+", "")) == F.lower(F.regexp_replace(t, r"[\p{P}\p{S}\p{Z}\s]+", ""))
    issues = F.array(
        F.when(asked & ~given, "missing"), F.when(given & ~asked, "extra"), F.when(asked & given & (t == ""), "empty"), F.when(said & same & W.translatable(s), "source_echo"),
        F.when(said & ~R.has_chinese(t) & W.translatable(s), "target_without_chinese"), F.when(said & R.polluted(t), "text_pollution"), F.when(said & R.leaves_marker(t), "short_english_leak"),
    )
    return both.select(*key, F.explode(F.array_compact(issues)).alias("issue"))


#: Codes of a target's own faults, whose weights say whether a repair made it better.
TARGET_CODES = ("target_open_ending", "target_too_short", "target_text_pollution", "target_untranslated_discourse_marker", "target_short_english_leak", "number_mismatch")


def repair_gain(before: Column, after: Column) -> Column:
    """By how much a repair lowers the weight of a target's faults (arrays as ``risk_codes`` gives); negative if it makes it worse."""
    weigh = lambda codes: F.aggregate(F.filter(codes, lambda c: c.code.isin(*TARGET_CODES)), F.lit(0), lambda a, c: a + c.weight)
    return weigh(before) - weigh(after)


def blocking_span(counts: Column, severity: Column) -> Column:
    """Whether a difficult span (counts of its codes, a map) stops the output: foreign script, or a target too short or with numbers missing where source and target are open too."""
    n = lambda code: F.coalesce(F.try_element_at(counts, F.lit(code)), F.lit(0))
    edge = n("source_starts_with_continuation") + n("source_ends_with_open_word")
    stops = (n("target_text_pollution") > 0) | ((n("target_too_short") > 0) & ((n("target_open_ending") >= 1) | (edge >= 1))) | ((n("number_mismatch") > 0) & (n("target_open_ending") >= 4) & (n("source_open_clause") >= 6))
    return (severity == "high") & stops
