"""Queries on segments and cues: neighbours, spans, checks, metrics; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan import tables as T
from reelspan.functions import rules as R
from reelspan.operators import quality as Q
from reelspan.operators.overlap import best_overlap, chunk_of, chunk_plan
from reelspan.operators.sequences import islands, neighbours, renumber, running_last


def segment_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap before each timed segment, clamped at 0, and whether it overlaps the one before."""
    df = neighbours(T.timed(T.segments(spark, sf_dir)).select("video_id", "id", "start_ms", "end_ms"), ["video_id"], ["id", "end_ms"], after=False)
    return df.select("video_id", "id", F.col("prev.id").alias("prev_id"), F.greatest(F.col("start_ms") - F.col("prev.end_ms"), F.lit(0)).alias("gap_ms"), F.coalesce(F.col("start_ms") < F.col("prev.end_ms"), F.lit(False)).alias("overlaps"))


def adjacent_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed segments whose source is that of the one before."""
    df = T.timed(T.segments(spark, sf_dir)).select("video_id", "id", "start_ms", "end_ms", R.squash(F.col("source_text")).alias("text"))
    df = neighbours(df, ["video_id"], ["id", "text"], after=False)
    return df.where("text <> '' AND text = prev.text").select("video_id", "id", F.col("prev.id").alias("prev_id"), "text")


def segment_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of the two neighbours on either side, joined in order."""
    df = T.timed(T.segments(spark, sf_dir)).select("video_id", "id", "start_ms", "end_ms", R.squash(F.col("source_text")).alias("text"))
    df = neighbours(df, ["video_id"], ["text"]).select("*", F.col("prev.text").alias("p1"), F.col("next.text").alias("n1")).drop("prev", "next")
    df = neighbours(df, ["video_id"], ["p1", "n1"])
    return df.select("video_id", "id", F.concat_ws(" | ", F.col("prev.p1"), "p1", "text", "n1", F.col("next.n1")).alias("context"))


def renumbered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed segments numbered 1, 2, … in the order of time."""
    return renumber(T.timed(T.segments(spark, sf_dir)).select("video_id", "id", "start_ms", "end_ms"), ["video_id"]).select("video_id", "id", "seq")


def running_last_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each timed segment the last target before it that isn't blank."""
    t = R.squash(F.col("target_text"))
    df = running_last(T.timed(T.segments(spark, sf_dir)).drop("source_text"), ["video_id"], F.when(t != "", t), "last_target")
    return df.select("video_id", "id", "last_target")


def talk_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of segments that start at most 10 s after one another."""
    df = neighbours(T.timed(T.segments(spark, sf_dir)).select("video_id", "id", "start_ms", "end_ms"), ["video_id"], ["start_ms"], after=False)
    df = islands(df.withColumn("_new", F.coalesce(F.col("start_ms") - F.col("prev.start_ms") > 10_000, F.lit(True))).drop("prev"), ["video_id"], F.col("_new"), "session")
    return df.groupBy("video_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def chinese_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual lines without Chinese signs go to the Chinese line before: text in order, the furthest end."""
    df = T.timed(T.dialogues(spark, sf_dir).where("layer = 0")).select("video_id", F.col("dialogue_id").alias("id"), "start_ms", "end_ms", T.clean_dialogue(F.col("text")).alias("text"))
    df = islands(df, ["video_id"], R.has_chinese(F.col("text")), "line")
    return df.where("line > 0").groupBy("video_id", "line").agg(F.min("id").alias("first_id"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "id", "text"))), lambda x: x.text), " ").alias("text"))


def source_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of segments of one sentence, at most eight each, with score and strategy."""
    spans = Q.source_spans(T.timed(T.segments(spark, sf_dir)))
    return spans.select("video_id", "start_id", "end_id", "start_ms", "end_ms", "n_segments", "risk_score", "strategy", F.array_join(F.transform(F.map_entries("reason_counts"), lambda e: F.concat_ws(":", e.key, e.value)), ",").alias("reasons"), "source_joined")


def span_strategy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and segments of each strategy."""
    return Q.source_spans(T.timed(T.segments(spark, sf_dir))).groupBy("strategy").agg(F.count(F.lit(1)).alias("n_spans"), F.sum("n_segments").alias("n_segments"))


def segment_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted findings on each segment, a row each."""
    df = T.segments(spark, sf_dir)
    return df.select("video_id", "id", F.explode(Q.risk_codes(F.col("source_text"), F.col("target_text"), F.col("start_ms"), F.col("end_ms"))).alias("r")).select("video_id", "id", F.col("r.code").alias("code"), F.col("r.weight").alias("weight"))


def risk_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 segments of highest risk, ties in order of video and id."""
    df = T.segments(spark, sf_dir)
    codes = Q.risk_codes(F.col("source_text"), F.col("target_text"), F.col("start_ms"), F.col("end_ms"))
    scored = df.select("video_id", "id", F.aggregate(codes, F.lit(0), lambda acc, r: acc + r.weight).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "video_id", "id").limit(50)


def segment_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural findings on segments."""
    return Q.segment_checks(T.segments(spark, sf_dir))


def check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each structural finding occurs, and in how many videos."""
    return Q.segment_checks(T.segments(spark, sf_dir)).groupBy("check").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("video_id").alias("n_videos"))


def cue_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues that say what the last cue with text said."""
    return Q.cue_repeats(T.timed(T.cues(spark, sf_dir)))


def cue_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose cues all say the same."""
    return Q.cue_runs(T.cues(spark, sf_dir))


def cue_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues over the soft or hard limits of length and speed."""
    df = T.timed(T.cues(spark, sf_dir)).select("video_id", "cue_id", R.visible_length(F.col("zh_text")).alias("length"), (R.visible_length(F.col("zh_text")) * 1000 / (F.col("end_ms") - F.col("start_ms"))).alias("cps"))
    return df.select("video_id", "cue_id", R.severity(F.col("length"), 28, 36).alias("length_severity"), R.severity(F.col("cps"), 18, 24).alias("cps_severity")).where("length_severity IS NOT NULL OR cps_severity IS NOT NULL")


def cue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of each segment: how many, which come first and last, and how many the cues claim there are."""
    df = T.cues(spark, sf_dir, "group_index", "group_total").where("source_segment_id IS NOT NULL")
    return df.groupBy("video_id", "source_segment_id").agg(F.count(F.lit(1)).alias("n_cues"), F.min("group_index").alias("first_index"), F.max("group_index").alias("last_index"), F.max("group_total").alias("group_total"))


def video_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and times of each video's segments."""
    return Q.video_metrics(T.segments(spark, sf_dir))


def manual_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manual Chinese line that each segment overlaps most, if by 35 % of its time or more, and whether it changed the target."""
    lines = T.timed(T.dialogues(spark, sf_dir)).where((F.col("layer") == 0) & R.has_chinese(F.col("text"))).select("video_id", "dialogue_id", "start_ms", "end_ms", T.clean_dialogue(F.col("text")).alias("clean"))
    left = T.timed(T.segments(spark, sf_dir)).select("video_id", "id", "start_ms", "end_ms", R.squash(F.col("target_text")).alias("machine"))
    best = best_overlap(left, lines, "video_id", ["video_id", "id"], "dialogue_id")
    return best.where("l.machine <> '' AND r.clean <> ''").select("l.video_id", "l.id", "r.dialogue_id", "overlap_ms", (F.col("l.machine") != F.col("r.clean")).alias("changed"))


def chunked_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and the 8-minute chunk of their video's time that holds their middle."""
    df = T.timed(T.segments(spark, sf_dir)).select("video_id", "id", "start_ms", "end_ms")
    totals = df.groupBy("video_id").agg(F.max("end_ms").alias("total_ms"))
    both = df.join(totals, "video_id")
    return both.select("video_id", "id", chunk_of(F.floor((F.col("start_ms") + F.col("end_ms")) / 2), 480_000, F.col("total_ms")).alias("chunk"))


def chunk_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each video with a second of overlap."""
    totals = T.timed(T.segments(spark, sf_dir)).groupBy("video_id").agg(F.max("end_ms").alias("total_ms"))
    return chunk_plan(totals, "total_ms").select("video_id", "chunk", "core_start_ms", "core_end_ms", "start_ms", "end_ms", "is_last")


def subtitle_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of cues as text in both subtitle formats, and read back."""
    df = T.timed(T.cues(spark, sf_dir))
    return df.select("video_id", "cue_id", R.srt_time(F.col("start_ms")).alias("srt"), R.ass_time(F.col("end_ms")).alias("ass"), R.parse_clock(R.srt_time(F.col("start_ms"))).alias("back_ms"))


def latin_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with Chinese signs of which a tenth or more of the visible text is Latin letters."""
    df = T.segments(spark, sf_dir).where(R.has_chinese(F.col("target_text")))
    return df.select("video_id", "id", R.latin_share(F.col("target_text")).alias("latin_share")).where("latin_share >= 0.1")


def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of targets and how often each occurs."""
    df = T.segments(spark, sf_dir).where("target_text IS NOT NULL")
    return df.groupBy(R.text_shape(F.col("target_text")).alias("shape")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


_TIMED = f"WITH {T.SEGMENTS_SQL}, t AS (SELECT * FROM seg WHERE end_ms > start_ms)"
_SQ = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))"
_VL = lambda c: f"length(regexp_replace(coalesce({c}, ''), '[\\s\\p{{Z}}]+', '', 'g'))"
_ZH = lambda c: f"coalesce(regexp_matches({c}, '[\\x{{3400}}-\\x{{9fff}}]'), false)"
_END = lambda c: f"regexp_matches({_SQ(c)}, '[.!?。！？][\"'')\\]]*$')"
_W = "[A-Za-z][A-Za-z0-9''.-]*"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_CONT = lambda c: f"(regexp_replace(lower(regexp_extract({_SQ(c)}, '^[^A-Za-z]*({_W})', 1)), '[.'']+$', '') IN {_IN(R.CONTINUATION_WORDS)})"
_OPEN = lambda c: f"(regexp_replace(lower(regexp_extract({_SQ(c)}, '({_W})[^A-Za-z]*$', 1)), '[.'']+$', '') IN {_IN(R.OPEN_END_WORDS)})"
_ORD = "ORDER BY start_ms, end_ms, id"
_OT = "(" + "|".join(R.OPEN_TARGET_ENDS) + ")$"
_NUM = lambda c: f"regexp_extract_all(coalesce({c}, ''), '\\d+(?:[.,]\\d+)?')"

_LEFT = "|".join(w.replace("'", "''") for w in R.LEFT_MARKERS)
_POLLUTED = "regexp_matches(t, '[" + "".join(f"\\x{{{a:04x}}}-\\x{{{b:04x}}}" for a, b in R.TARGET_SCRIPTS) + "]|" + R.BROKEN + f"') OR len(list_distinct(regexp_extract_all(t, '[{R.BROKEN_HINTS}]'))) >= 4"
_LEAVES = f"zh AND regexp_matches(replace(replace(t, '`', ''''), '’', ''''), '(?i)(?:^|[^A-Za-z0-9_.-])(?:{_LEFT})(?:$|[^A-Za-z0-9_-])')"
_SAID = f"list_filter(list_transform(regexp_split_to_array(s, '[.!?。！？]+'), lambda p: list_transform(regexp_extract_all(p, '{_W}'), lambda w: regexp_replace(lower(w), '''+$', ''))), lambda p: len(p) BETWEEN 2 AND 6)"
_REPEATS = f"regexp_matches(s, '[.!?。！？].*[A-Za-z]') AND len(list_distinct({_SAID})) < len({_SAID})"

_RISK = f"""
SELECT video_id, id, unnest([
  CASE WHEN {_CONT('s')} THEN {{'code': 'source_starts_with_continuation', 'weight': 1}} END,
  CASE WHEN s <> '' AND NOT {_END('s')} THEN {{'code': 'source_open_clause', 'weight': 1}} END,
  CASE WHEN {_OPEN('s')} THEN {{'code': 'source_ends_with_open_word', 'weight': 2}} END,
  CASE WHEN regexp_matches(t, '{_OT}') THEN {{'code': 'target_open_ending', 'weight': 2}} END,
  CASE WHEN zh AND {_VL('t')} <= 3 AND {_VL('s')} >= 10 THEN {{'code': 'target_too_short', 'weight': 4}} END,
  CASE WHEN len(list_filter({_NUM('s')}, lambda x: NOT list_contains({_NUM('t')}, x))) > 0 AND {_VL('s')} >= 12 THEN {{'code': 'number_mismatch', 'weight': 2}} END,
  CASE WHEN zh AND cps > 18 AND cps < 22.5 THEN {{'code': 'target_cps_high', 'weight': 1}} END,
  CASE WHEN zh AND cps >= 22.5 THEN {{'code': 'target_cps_very_high', 'weight': 2}} END,
  CASE WHEN zh AND {_VL('t')} > 28 THEN {{'code': 'target_line_long', 'weight': 1}} END,
  CASE WHEN {_POLLUTED} THEN {{'code': 'target_text_pollution', 'weight': 6}} END,
  CASE WHEN {_LEAVES} THEN {{'code': 'target_untranslated_discourse_marker', 'weight': 6}} END,
  CASE WHEN {_LEAVES} THEN {{'code': 'target_short_english_leak', 'weight': 7}} END,
  CASE WHEN {_REPEATS} THEN {{'code': 'source_repeated_short_phrase', 'weight': 4}} END]) AS r
FROM (SELECT *, {_VL('t')} / (greatest(end_ms - start_ms, 1) / 1000.0) AS cps, {_ZH('t')} AS zh FROM (SELECT video_id, id, start_ms, end_ms, {_SQ('source_text')} AS s, {_SQ('target_text')} AS t FROM seg))"""

_CHECKS = f"""
SELECT * FROM (SELECT video_id, id, unnest([
  CASE WHEN start_ms < lag(end_ms) OVER w THEN 'overlap' END,
  CASE WHEN t <> '' AND t = lag(t) OVER w THEN 'adjacent_repeat' END,
  CASE WHEN {_ZH('t')} AND {_VL('t')} / ((end_ms - start_ms) / 1000.0) > 18 THEN 'too_fast' END]) AS "check"
FROM (SELECT *, {_SQ('target_text')} AS t FROM seg WHERE end_ms > start_ms) WINDOW w AS (PARTITION BY video_id {_ORD})) WHERE "check" IS NOT NULL
UNION ALL SELECT * FROM (SELECT video_id, id, unnest([
  CASE WHEN start_ms IS NULL OR end_ms IS NULL OR end_ms <= start_ms THEN 'bad_time' END,
  CASE WHEN s = '' THEN 'empty_source' END, CASE WHEN t = '' THEN 'empty_target' END,
  CASE WHEN s <> '' AND lower(s) = lower(t) THEN 'echo' END, CASE WHEN {_VL('s')} > 84 THEN 'too_long' END]) AS "check"
FROM (SELECT *, {_SQ('source_text')} AS s, {_SQ('target_text')} AS t FROM seg)) WHERE "check" IS NOT NULL"""

_SPANS = f"""
WITH {T.SEGMENTS_SQL},
n AS (SELECT video_id, id, start_ms, end_ms, {_SQ('source_text')} AS s, lag(end_ms) OVER w AS p_end, lead(start_ms) OVER w AS n_start FROM seg WHERE end_ms > start_ms WINDOW w AS (PARTITION BY video_id {_ORD})),
r AS (SELECT *, list_filter([
  CASE WHEN s = '' THEN 'empty_source' END, CASE WHEN {_CONT('s')} THEN 'starts_with_continuation' END, CASE WHEN {_OPEN('s')} THEN 'ends_with_function_word' END,
  CASE WHEN s <> '' AND NOT {_END('s')} THEN 'open_clause' END, CASE WHEN s <> '' AND NOT {_END('s')} AND len(regexp_extract_all(s, '[A-Za-z0-9'']+')) <= 8 THEN 'short_open_fragment' END,
  CASE WHEN regexp_matches(s, '[a-z0-9][.!?] +[A-Z0-9]') THEN 'internal_sentence_boundary' END, CASE WHEN regexp_matches(s, '[,;:]') AND length(s) >= 50 THEN 'internal_clause_boundary' END,
  CASE WHEN p_end IS NOT NULL AND greatest(start_ms - p_end, 0) <= 350 AND {_CONT('s')} THEN 'tight_previous_continuation' END,
  CASE WHEN n_start IS NOT NULL AND greatest(n_start - end_ms, 0) <= 350 AND s <> '' AND NOT {_END('s')} THEN 'tight_next_open_clause' END], lambda x: x IS NOT NULL) AS reasons FROM n),
j AS (SELECT *, lag(end_ms) OVER w AS pe, lag(s) OVER w AS ps, lag(reasons) OVER w AS pr FROM r WINDOW w AS (PARTITION BY video_id {_ORD})),
k AS (SELECT *, CASE WHEN coalesce(s <> '' AND ps <> '' AND ((greatest(start_ms - pe, 0) <= 350 AND NOT {_END('ps')})
   OR (greatest(start_ms - pe, 0) <= 750 AND (list_contains(pr, 'ends_with_function_word') OR list_contains(reasons, 'starts_with_continuation') OR list_contains(pr, 'short_open_fragment') OR list_contains(reasons, 'short_open_fragment') OR list_contains(pr, 'tight_next_open_clause')))
   OR (list_contains(reasons, 'starts_with_continuation') AND NOT {_END('ps')})), false) THEN 0 ELSE 1 END AS opens FROM j),
c AS (SELECT *, sum(opens) OVER (PARTITION BY video_id {_ORD} ROWS UNBOUNDED PRECEDING) AS chain FROM k),
d AS (SELECT *, (row_number() OVER (PARTITION BY video_id, chain {_ORD}) - 1) // 8 AS part FROM c),
g AS (SELECT video_id, chain, part, list(id {_ORD}) AS ids, list(end_ms {_ORD}) AS ends, min(start_ms) AS start_ms, count(*) AS n_segments, flatten(list(reasons {_ORD})) AS rs, {_SQ(f"string_agg(s, ' ' {_ORD})")} AS joined FROM d GROUP BY 1, 2, 3),
h AS (SELECT *, ids[1] AS start_id, ids[-1] AS end_id, ends[-1] AS end_ms,
  len(list_filter(rs, lambda x: x = 'ends_with_function_word')) * 3 + len(list_filter(rs, lambda x: x = 'short_open_fragment')) * 3 + len(list_filter(rs, lambda x: x = 'internal_sentence_boundary')) * 2
  + len(list_filter(rs, lambda x: x = 'starts_with_continuation')) * 2 + len(list_filter(rs, lambda x: x = 'open_clause')) + greatest(length(joined) - 120, 0) // 30 + CASE WHEN ends[-1] - start_ms > 18000 THEN 2 ELSE 0 END AS risk_score,
  length(joined) - length(replace(joined, ',', '')) AS commas FROM g),
spans AS (SELECT video_id, start_id, end_id, start_ms, end_ms, n_segments, CAST(risk_score AS BIGINT) AS risk_score,
  CASE WHEN n_segments <= 4 AND end_ms - start_ms <= 12000 AND risk_score >= 10 AND list_contains(rs, 'ends_with_function_word') AND (list_contains(rs, 'starts_with_continuation') OR list_contains(rs, 'tight_previous_continuation')) THEN 'span_first'
    WHEN list_contains(rs, 'internal_sentence_boundary') OR (n_segments >= 2 AND (list_contains(rs, 'starts_with_continuation') OR list_contains(rs, 'ends_with_function_word') OR list_contains(rs, 'short_open_fragment') OR len(list_filter(rs, lambda x: x = 'open_clause')) >= 2)) OR length(joined) >= 120 OR commas >= 2 THEN 'span_context' ELSE 'normal' END AS strategy,
  array_to_string(list_transform(list_sort(list_distinct(rs)), lambda x: x || ':' || len(list_filter(rs, lambda y: y = x))), ',') AS reasons, joined AS source_joined
  FROM h WHERE n_segments > 1 OR list_contains(rs, 'short_open_fragment') OR list_contains(rs, 'internal_sentence_boundary') OR length(joined) >= 120 OR commas >= 2)
"""

QUERIES = {f.__name__: f for f in (
    segment_gaps, adjacent_duplicates, segment_context, renumbered_segments, running_last_target, talk_sessions, chinese_carry, source_spans, span_strategy_counts, segment_risks, risk_top,
    segment_checks, check_counts, cue_repeats, cue_runs, cue_severity, cue_groups, video_metrics, manual_alignment, chunked_segments, chunk_plans, subtitle_times, latin_residue, text_shapes,
)}

SQL = {
    "segment_gaps": f"{_TIMED} SELECT video_id, id, lag(id) OVER w AS prev_id, CASE WHEN lag(end_ms) OVER w IS NOT NULL THEN greatest(start_ms - lag(end_ms) OVER w, 0) ELSE 0 END AS gap_ms, coalesce(start_ms < lag(end_ms) OVER w, false) AS overlaps FROM t WINDOW w AS (PARTITION BY video_id {_ORD})",
    "adjacent_duplicates": f"{_TIMED} SELECT video_id, id, prev_id, text FROM (SELECT video_id, id, lag(id) OVER w AS prev_id, text, lag(text) OVER w AS before FROM (SELECT *, {_SQ('source_text')} AS text FROM t) WINDOW w AS (PARTITION BY video_id {_ORD})) WHERE text <> '' AND text = before",
    "segment_context": f"{_TIMED} SELECT video_id, id, concat_ws(' | ', lag(x, 2) OVER w, lag(x) OVER w, x, lead(x) OVER w, lead(x, 2) OVER w) AS context FROM (SELECT *, {_SQ('source_text')} AS x FROM t) WINDOW w AS (PARTITION BY video_id {_ORD})",
    "renumbered_segments": f"{_TIMED} SELECT video_id, id, row_number() OVER (PARTITION BY video_id {_ORD}) AS seq FROM t",
    "running_last_target": f"{_TIMED} SELECT video_id, id, last_value(nullif({_SQ('target_text')}, '') IGNORE NULLS) OVER (PARTITION BY video_id {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_target FROM t",
    "talk_sessions": f"{_TIMED}, m AS (SELECT *, CASE WHEN start_ms - lag(start_ms) OVER (PARTITION BY video_id {_ORD}) <= 10000 THEN 0 ELSE 1 END AS new FROM t), g AS (SELECT *, sum(new) OVER (PARTITION BY video_id {_ORD} ROWS UNBOUNDED PRECEDING) AS session FROM m) SELECT video_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY 1, 2",
    "chinese_carry": f"WITH {T.DIALOGUES_SQL}, g AS (SELECT *, sum(CASE WHEN {_ZH('clean')} THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, dialogue_id ROWS UNBOUNDED PRECEDING) AS line FROM dlg WHERE layer = 0 AND end_ms > start_ms) SELECT video_id, CAST(line AS BIGINT) AS line, min(dialogue_id) AS first_id, max(end_ms) AS end_ms, string_agg(clean, ' ' ORDER BY start_ms, end_ms, dialogue_id) AS text FROM g WHERE line > 0 GROUP BY 1, 2",
    "source_spans": f"{_SPANS} SELECT * FROM spans",
    "span_strategy_counts": f"{_SPANS} SELECT strategy, count(*) AS n_spans, CAST(sum(n_segments) AS BIGINT) AS n_segments FROM spans GROUP BY 1",
    "segment_risks": f"WITH {T.SEGMENTS_SQL} SELECT video_id, id, r.code AS code, r.weight AS weight FROM ({_RISK}) WHERE r IS NOT NULL",
    "risk_top": f"WITH {T.SEGMENTS_SQL} SELECT video_id, id, CAST(sum(r.weight) AS INT) AS score FROM ({_RISK}) WHERE r IS NOT NULL GROUP BY 1, 2 ORDER BY score DESC, video_id, id LIMIT 50",
    "segment_checks": f"WITH {T.SEGMENTS_SQL} {_CHECKS}",
    "check_counts": f'WITH {T.SEGMENTS_SQL}, c AS ({_CHECKS}) SELECT "check", count(*) AS n, count(DISTINCT video_id) AS n_videos FROM c GROUP BY 1',
    "cue_repeats": f"WITH {T.CUES_SQL} SELECT video_id, cue_id, x AS zh_text FROM (SELECT video_id, cue_id, x, last_value(x IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, cue_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT *, nullif({_SQ('zh_text')}, '') AS x FROM cue WHERE end_ms > start_ms)) WHERE x = before",
    "cue_runs": f"WITH {T.CUES_SQL} SELECT video_id, source_segment_id, count(*) AS n_cues FROM (SELECT *, {_SQ('zh_text')} AS x FROM cue) WHERE source_segment_id IS NOT NULL AND x <> '' GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT x) = 1",
    "cue_severity": f"WITH {T.CUES_SQL}, m AS (SELECT video_id, cue_id, {_VL('zh_text')} AS n, {_VL('zh_text')} * 1000 / (end_ms - start_ms) AS cps FROM cue WHERE end_ms > start_ms), s AS (SELECT video_id, cue_id, CASE WHEN n > 36 THEN 'hard' WHEN n > 28 THEN 'soft' END AS length_severity, CASE WHEN cps > 24 THEN 'hard' WHEN cps > 18 THEN 'soft' END AS cps_severity FROM m) SELECT * FROM s WHERE length_severity IS NOT NULL OR cps_severity IS NOT NULL",
    "cue_groups": f"WITH {T.CUES_SQL} SELECT video_id, source_segment_id, count(*) AS n_cues, min(group_index) AS first_index, max(group_index) AS last_index, max(group_total) AS group_total FROM cue WHERE source_segment_id IS NOT NULL GROUP BY 1, 2",
    "video_metrics": f"""WITH {T.SEGMENTS_SQL}, x AS (SELECT *, {_SQ('source_text')} AS s, {_SQ('target_text')} AS t, coalesce(end_ms > start_ms, false) AS ok FROM seg)
SELECT video_id, count(*) AS n_segments, count_if(ok) AS n_timed, CAST(coalesce(sum(CASE WHEN ok THEN end_ms - start_ms END), 0) AS BIGINT) AS total_ms, max(CASE WHEN ok THEN end_ms - start_ms END) AS longest_ms, count_if(ok AND end_ms - start_ms > 6500) AS n_over_6500_ms,
count_if(s = '') AS n_empty_source, count_if(t = '') AS n_empty_target, count_if(s <> '' AND NOT {_END('s')}) AS n_open_clause, count_if(s <> '' AND len(regexp_extract_all(s, '[A-Za-z0-9'']+')) <= 5) AS n_short,
count_if({_CONT('s')} OR {_OPEN('s')}) AS n_function_edge, count_if({_ZH('t')}) AS n_chinese FROM x GROUP BY 1""",
    "manual_alignment": f"""{_TIMED}, {T.DIALOGUES_SQL}, l AS (SELECT * FROM dlg WHERE layer = 0 AND end_ms > start_ms AND {_ZH('text')}),
p AS (SELECT t.video_id, t.id, l.dialogue_id, {_SQ('t.target_text')} AS machine, l.clean, t.end_ms - t.start_ms AS d, least(t.end_ms, l.end_ms) - greatest(t.start_ms, l.start_ms) AS o, l.start_ms AS ls FROM t JOIN l ON t.video_id = l.video_id AND t.start_ms < l.end_ms AND l.start_ms < t.end_ms),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id, id ORDER BY o DESC, ls, dialogue_id) AS k FROM p)
SELECT video_id, id, dialogue_id, o AS overlap_ms, machine <> clean AS changed FROM b WHERE k = 1 AND o >= 0.35 * d AND machine <> '' AND clean <> ''""",
    "chunked_segments": f"{_TIMED}, m AS (SELECT video_id, max(end_ms) AS total FROM t GROUP BY 1) SELECT t.video_id, id, CAST(least(greatest((start_ms + end_ms) // 2 // 480000, 0), greatest(ceil(total / 480000) - 1, 0)) AS BIGINT) AS chunk FROM t JOIN m USING (video_id)",
    "chunk_plans": f"""{_TIMED}, m AS (SELECT video_id, max(end_ms) AS total, CAST(greatest(ceil(max(end_ms) / 480000) - 1, 0) AS BIGINT) AS last FROM t GROUP BY 1), c AS (SELECT *, unnest(range(last + 1)) AS chunk FROM m)
SELECT video_id, chunk, chunk * 480000 AS core_start_ms, least(chunk * 480000 + 480000, total) AS core_end_ms, greatest(chunk * 480000 - 1000, 0) AS start_ms, least(least(chunk * 480000 + 480000, total) + 1000, total) AS end_ms, chunk = last AS is_last FROM c""",
    "subtitle_times": f"""WITH {T.CUES_SQL}, c AS (SELECT *, (greatest(end_ms, 0) + 5) // 10 AS cs FROM cue WHERE end_ms > start_ms)
SELECT video_id, cue_id, printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS srt, printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS ass, start_ms AS back_ms FROM c""",
    "latin_residue": f"WITH {T.SEGMENTS_SQL}, m AS (SELECT video_id, id, length(regexp_replace(target_text, '[^A-Za-z]', '', 'g')) / {_VL('target_text')} AS latin_share FROM seg WHERE {_ZH('target_text')}) SELECT * FROM m WHERE latin_share >= 0.1",
    "text_shapes": f"WITH {T.SEGMENTS_SQL}, s AS (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace({_SQ('target_text')}, '[\\x{{3400}}-\\x{{9fff}}]+', chr(1), 'g'), '[A-Za-z][A-Za-z''-]*', 'EN', 'g'), '[0-9]+(?:[.,][0-9]+)*', 'NUM', 'g'), chr(1), 'ZH', 'g') AS shape FROM seg WHERE target_text IS NOT NULL) SELECT shape, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 1",
}
