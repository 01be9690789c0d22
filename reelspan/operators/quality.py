"""Risk codes, structural checks and metrics of segments and cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions import rules as R
from reelspan.operators.sequences import neighbours, running_last, running_sums
from reelspan.runtime import cut_lineage

MAX_CPS, MAX_CHARS = 18.0, 28


def risk_codes(source: Column, target: Column, start_ms: Column, end_ms: Column, *, max_cps: float = MAX_CPS, max_chars: int = MAX_CHARS) -> Column:
    """Weighted findings on a segment, an array of ``(code, weight)``.

    Null texts are empty; a null time makes no rate. Every rule is one JVM expression.
    """
    s, t = R.squash(source), R.squash(target)
    zh, cps = R.has_chinese(t), R.characters_per_second(t, start_ms, end_ms)
    missing = F.size(F.array_except(R.numbers(s), R.numbers(t))) > 0
    found = [
        ("source_starts_with_continuation", 1, R.opens_with_continuation(s)),
        ("source_open_clause", 1, (s != "") & ~R.ends_sentence(s)),
        ("source_ends_with_open_word", 2, R.ends_with_open_word(s)),
        ("target_open_ending", 2, R.ends_with_open_target(t)),
        ("target_too_short", 4, zh & (R.visible_length(t) <= 3) & (R.visible_length(s) >= 10)),
        ("number_mismatch", 2, missing & (R.visible_length(s) >= 12)),
        ("target_cps_high", 1, zh & (cps > max_cps) & (cps < max_cps * 1.25)),
        ("target_cps_very_high", 2, zh & (cps >= max_cps * 1.25)),
        ("target_line_long", 1, zh & (R.visible_length(t) > max_chars)),
    ]
    return F.concat(_codes(found), text_codes(source, target))


def text_codes(source: Column, target: Column) -> Column:
    """Weighted findings on the texts alone, as ``risk_codes`` gives them: foreign script or broken encoding, an English marker left (twice, as marker and as fragment), a phrase said twice."""
    s, t = R.squash(source), R.squash(target)
    return _codes([
        ("target_text_pollution", 6, R.polluted(t)), ("target_untranslated_discourse_marker", 6, R.leaves_marker(t)),
        ("target_short_english_leak", 7, R.leaves_marker(t)), ("source_repeated_short_phrase", 4, R.repeats_phrase(s)),
    ])


def _codes(found: list[tuple[str, int, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(w).alias("weight"))) for code, w, cond in found]))


def source_reasons(df: DataFrame) -> DataFrame:
    """``df`` (with ``prev``, ``next`` of ``neighbours``) with ``reasons``: why a segment's source can't stand alone."""
    s = R.squash(F.col("source_text"))
    words = F.size(F.regexp_extract_all(s, F.lit("([A-Za-z0-9']+)"), 1))
    before = F.col("start_ms") - F.col("prev.end_ms")
    after = F.col("next.start_ms") - F.col("end_ms")
    found = [
        ("empty_source", s == ""),
        ("starts_with_continuation", R.opens_with_continuation(s)),
        ("ends_with_function_word", R.ends_with_open_word(s)),
        ("open_clause", (s != "") & ~R.ends_sentence(s)),
        ("short_open_fragment", (s != "") & ~R.ends_sentence(s) & (words <= 8)),
        ("internal_sentence_boundary", s.rlike(r"[a-z0-9][.!?] +[A-Z0-9]")),
        ("internal_clause_boundary", s.rlike("[,;:]") & (F.length(s) >= 50)),
        ("tight_previous_continuation", (before <= 350) & R.opens_with_continuation(s)),
        ("tight_next_open_clause", (after <= 350) & (s != "") & ~R.ends_sentence(s)),
    ]
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in found])))


# Points of each reason in a span's score.
REASON_POINTS = {"ends_with_function_word": 3, "short_open_fragment": 3, "internal_sentence_boundary": 2, "starts_with_continuation": 2, "open_clause": 1}


def source_spans(segments: DataFrame, *, most: int = 8) -> DataFrame:
    """Chains of segments that belong to one sentence, cut to ``most`` segments, with reasons, score and strategy.

    ``video_id, span, start_id, end_id, segment_ids, start_ms, end_ms, n_segments, reason_counts, risk_score, strategy, source_joined``.
    Joining looks at two neighbours only, so chains are islands of a running sum over time shards; a chain is cut into pieces by its rows' numbers
    from the chain's first, which running values carry too, so a chain of any length is no group. What several steps read is written once.
    A segment alone is a span only if its reasons or length ask for it. Segments without times don't count.
    """
    rows = cut_lineage(segments.select("video_id", "id", "start_ms", "end_ms", "source_text"))
    own = cut_lineage(source_reasons(neighbours(rows, ["video_id"], ["start_ms", "end_ms", "id", "source_text"])).drop("prev", "next"))
    marked = neighbours(own, ["video_id"], ["end_ms", "source_text", "reasons"], after=False)
    gap = F.greatest(F.col("start_ms") - F.col("prev.end_ms"), F.lit(0))
    open_before = ~R.ends_sentence(F.col("prev.source_text"))
    soft = F.array_contains("prev.reasons", "ends_with_function_word") | F.array_contains("reasons", "starts_with_continuation") | F.array_contains("prev.reasons", "short_open_fragment") | F.array_contains("reasons", "short_open_fragment") | F.array_contains("prev.reasons", "tight_next_open_clause")
    both = (R.squash(F.col("source_text")) != "") & (R.squash(F.col("prev.source_text")) != "")
    joins = both & (((gap <= 350) & open_before) | ((gap <= 750) & soft) | (F.array_contains("reasons", "starts_with_continuation") & open_before))
    opens = cut_lineage(marked.withColumn("_opens", ~F.coalesce(joins, F.lit(False))).drop("prev"))
    numbered = cut_lineage(running_sums(opens, ["video_id"], {"chain": F.when(F.col("_opens"), 1).otherwise(0), "_seq": F.lit(1)}))
    first = F.when(F.col("_opens"), F.col("_seq"))
    chained = running_last(numbered, ["video_id"], first, "_first").withColumn("_first", F.coalesce(first, F.col("_first")))
    pieces = chained.withColumn("part", F.floor((F.col("_seq") - F.col("_first")) / most))
    one = F.struct("start_ms", "end_ms", "id", R.squash(F.col("source_text")).alias("text"))
    spans = pieces.groupBy("video_id", "chain", "part").agg(
        F.array_sort(F.collect_list(one)).alias("_rows"), F.flatten(F.collect_list("reasons")).alias("_reasons"), F.count(F.lit(1)).alias("n_segments"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("_last_end")
    )
    spans = spans.withColumn("segment_ids", F.col("_rows.id")).withColumn("source_joined", R.squash(F.array_join("_rows.text", " ")))
    spans = spans.withColumn("start_id", F.element_at("segment_ids", 1)).withColumn("end_id", F.element_at("segment_ids", -1)).withColumn("end_ms", F.element_at("_rows.end_ms", -1))
    codes = F.array_sort(F.array_distinct("_reasons"))
    count = lambda code: F.size(F.filter("_reasons", lambda r: r == code))
    spans = spans.withColumn("reason_counts", F.map_from_arrays(codes, F.transform(codes, count)))
    score = sum((count(F.lit(code)) * points for code, points in REASON_POINTS.items()), F.lit(0)) + F.floor(F.greatest(F.length("source_joined") - 120, F.lit(0)) / 30) + F.when(F.col("end_ms") - F.col("start_ms") > 18000, 2).otherwise(0)
    has = lambda code: F.array_contains("_reasons", code)
    commas = F.length("source_joined") - F.length(F.replace("source_joined", F.lit(","), F.lit("")))
    spans = spans.withColumn("risk_score", score.cast("bigint"))
    first = (F.col("n_segments") <= 4) & (F.col("end_ms") - F.col("start_ms") <= 12000) & (F.col("risk_score") >= 10) & has("ends_with_function_word") & (has("starts_with_continuation") | has("tight_previous_continuation"))
    context = has("internal_sentence_boundary") | ((F.col("n_segments") >= 2) & (has("starts_with_continuation") | has("ends_with_function_word") | has("short_open_fragment") | (count(F.lit("open_clause")) >= 2))) | (F.length("source_joined") >= 120) | (commas >= 2)
    spans = spans.withColumn("strategy", F.when(first, "span_first").when(context, "span_context").otherwise("normal"))
    wanted = (F.col("n_segments") > 1) | has("short_open_fragment") | has("internal_sentence_boundary") | (F.length("source_joined") >= 120) | (commas >= 2)
    return spans.where(wanted).select("video_id", F.concat_ws("-", F.col("chain"), F.col("part")).alias("span"), "start_id", "end_id", "segment_ids", "start_ms", "end_ms", "n_segments", "reason_counts", "risk_score", "strategy", "source_joined")


def segment_checks(segments: DataFrame) -> DataFrame:
    """Structural findings, a row each: ``video_id, id, check``.

    Checks: bad_time (null, or an end not after the start), overlap and adjacent_repeat against the neighbour before, empty_source, empty_target,
    echo (target is the source), too_fast (over 18 signs a second), too_long (over 84 characters).
    """
    s, t = R.squash(F.col("source_text")), R.squash(F.col("target_text"))
    ok = segments.where("start_ms IS NOT NULL AND end_ms IS NOT NULL AND end_ms > start_ms")
    near = neighbours(ok, ["video_id"], ["end_ms", "target_text"], after=False)
    pairwise = F.array_compact(F.array(
        F.when(F.col("start_ms") < F.col("prev.end_ms"), "overlap"),
        F.when((t != "") & (t == R.squash(F.col("prev.target_text"))), "adjacent_repeat"),
        F.when(R.has_chinese(t) & (R.characters_per_second(t, F.col("start_ms"), F.col("end_ms")) > MAX_CPS), "too_fast"),
    ))
    alone = F.array_compact(F.array(
        F.when(F.col("start_ms").isNull() | F.col("end_ms").isNull() | (F.col("end_ms") <= F.col("start_ms")), "bad_time"),
        F.when(s == "", "empty_source"), F.when(t == "", "empty_target"),
        F.when((s != "") & (F.lower(s) == F.lower(t)), "echo"), F.when(R.visible_length(s) > 84, "too_long"),
    ))
    return near.select("video_id", "id", F.explode(pairwise).alias("check")).unionByName(segments.select("video_id", "id", F.explode(alone).alias("check")))


def cue_repeats(cues: DataFrame) -> DataFrame:
    """Cues whose Chinese text is that of the last cue of the video that had any: ``video_id, cue_id, zh_text``."""
    text = F.when(R.squash(F.col("zh_text")) != "", R.squash(F.col("zh_text")))
    marked = running_last(cues.withColumn("id", F.col("cue_id")), ["video_id"], text, "last_text")
    return marked.where(text == F.col("last_text")).select("video_id", "cue_id", text.alias("zh_text"))


def cue_runs(cues: DataFrame) -> DataFrame:
    """Segments whose three or more cues all say the same: ``video_id, source_segment_id, n_cues``. Null segments don't count."""
    text = R.squash(F.col("zh_text"))
    runs = cues.where("source_segment_id IS NOT NULL").where(text != "").groupBy("video_id", "source_segment_id").agg(F.count(F.lit(1)).alias("n_cues"), F.countDistinct(text).alias("_n"))
    return runs.where("n_cues >= 3 AND _n = 1").drop("_n")


def video_metrics(segments: DataFrame) -> DataFrame:
    """One row a video of conditional counts and means over its segments."""
    s, t = R.squash(F.col("source_text")), R.squash(F.col("target_text"))
    timed = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull() & (F.col("end_ms") > F.col("start_ms"))
    words = F.size(F.regexp_extract_all(s, F.lit("([A-Za-z0-9']+)"), 1))
    return segments.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.count_if(timed).alias("n_timed"), F.coalesce(F.sum(F.when(timed, F.col("end_ms") - F.col("start_ms"))), F.lit(0)).alias("total_ms"),
        F.max(F.when(timed, F.col("end_ms") - F.col("start_ms"))).alias("longest_ms"), F.count_if(timed & (F.col("end_ms") - F.col("start_ms") > 6500)).alias("n_over_6500_ms"),
        F.count_if(s == "").alias("n_empty_source"), F.count_if(t == "").alias("n_empty_target"), F.count_if((s != "") & ~R.ends_sentence(s)).alias("n_open_clause"),
        F.count_if((s != "") & (words <= 5)).alias("n_short"), F.count_if(R.opens_with_continuation(s) | R.ends_with_open_word(s)).alias("n_function_edge"), F.count_if(R.has_chinese(t)).alias("n_chinese"),
    )
