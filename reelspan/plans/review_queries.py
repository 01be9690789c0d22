"""Queries on record rules, samples, review rows, clusters, job states and wrapping, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan import tables as T
from reelspan.functions import rules as R
from reelspan.functions import wrapping as L
from reelspan.operators import clusters as C
from reelspan.operators import feedback as B
from reelspan.operators import quality as Q
from reelspan.operators import records as E
from reelspan.operators import review as V
from reelspan.operators import terminology as G
from reelspan.plans.quality_queries import _CHECKS, _RISK, _SPANS, _SQ, _VL
from reelspan.plans.wording_queries import SQL as _WORDING
from reelspan.plans.wording_queries import translation_issues
from reelspan.runtime import read
from reelspan.streaming import jobs as J


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.best_per_key(read(spark, sf_dir, "span_translation_examples"), F.col("example_id"), F.struct("created_at")).drop("_key")


def _key() -> F.Column:
    return F.concat_ws("|", F.translate(F.lower(F.trim("project_id")), "_", "-"), "span_id")


def record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that span records break."""
    return E.violations(_unique(spark, sf_dir))


def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span records, their keys, repeats and those that break a rule."""
    return E.validation(_unique(spark, sf_dir), _key())


def gold_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted span records that serve as no example, one a key."""
    return E.gold_records(_unique(spark, sf_dir), _key()).select("example_id", F.col("_key").alias("record_key"))


def evaluation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty span records to evaluate, half of them accepted ones."""
    return E.evaluation_sample(_unique(spark, sf_dir), F.coalesce(F.col("accepted"), F.lit(False)), F.col("example_id"), 40).select("example_id", "accepted")


def bulk_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span records after the first hundred of low risk that weren't are accepted."""
    return E.bulk_updates(_unique(spark, sf_dir), F.col("risk_score") < 8, "accept", F.col("example_id"), 100).select("example_id", "accepted", "use_for_span_prompt", "updated")


def style_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How manual targets differ from machine ones, by strategy."""
    pair = F.explode(F.map_zip_with("machine_target_by_id", "manual_target_by_id", lambda k, a, b: F.struct(a.alias("machine"), b.alias("manual"))))
    rows = _unique(spark, sf_dir).select(F.col("translation_strategy").alias("strategy"), pair.alias("id", "p")).select("strategy", R.squash(F.col("p.machine")).alias("machine"), R.squash(F.col("p.manual")).alias("manual"))
    return E.style_profile(rows.where("machine <> '' AND manual <> ''"))


def span_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each video to translate as a whole, without segments that a term locks."""
    segs = T.timed(T.segments(spark, sf_dir))
    out = E.span_candidates(Q.source_spans(segs), G.lock_terms(segs, read(spark, sf_dir, "glossary_terms")), strategies=("span_first", "span_context"), least_score=6)
    return out.select("video_id", F.array_join(F.transform("segment_ids", lambda x: x.cast("string")), ",").alias("segment_ids"), "risk_score", "place")


def repair_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source spans close together, in clusters of up to 24 segments."""
    spans = Q.source_spans(T.timed(T.segments(spark, sf_dir)))
    return C.repair_clusters(spans.select("video_id", "span", F.least("start_id", "end_id").alias("start_id"), F.greatest("start_id", "end_id").alias("end_id"), F.col("risk_score").alias("score")))


def display_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues that are too long or too fast."""
    return V.display_issues(T.timed(T.cues(spark, sf_dir)))


def editor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer is shown of each segment: risk codes, structural checks, issues of translations, each kind once."""
    segs = T.segments(spark, sf_dir)
    codes = Q.risk_codes(F.col("source_text"), F.col("target_text"), F.col("start_ms"), F.col("end_ms"))
    risks = segs.select("video_id", "id", F.explode(codes).alias("c")).select("video_id", "id", F.col("c.code").alias("risk_type"), F.when(F.col("c.weight") >= 4, "high").otherwise("low").alias("severity"), F.col("c.weight").alias("score"))
    checks = Q.segment_checks(segs).select("video_id", "id", F.col("check").alias("risk_type"), F.lit("medium").alias("severity"), F.lit(3).alias("score"))
    issues = translation_issues(spark, sf_dir).select("video_id", "id", F.when(F.col("issue") == "text_pollution", "target_text_pollution").otherwise(F.col("issue")).alias("risk_type"), F.lit("high").alias("severity"), F.lit(5).alias("score"))
    return V.editor_rows([risks, checks, issues])


def event_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five events of each user, in the order they came."""
    events = read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    return J.event_tail(events, ["user_id"], ["ts", "event_id"], 5).select("user_id", "seq", "event_id", "event_type")


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as updates of one job a user: views tell progress, clicks and the like the status, purchases completion."""
    events = read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "value")
    updates = events.select(
        "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("status"),
        F.when(F.col("event_type") == "view", F.floor("value").cast("int")).alias("progress"), F.when(F.col("event_type") == "purchase", F.unix_micros(F.col("ts").cast("timestamp"))).alias("completed_at"),
    )
    return J.current_jobs(updates, ["user_id"], ["at", "event_id"])


def wrapped_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets wrapped into lines: how many lines, and whether any sign was lost or a short one broken."""
    text = R.squash(F.col("target_text"))
    rows = T.segments(spark, sf_dir).where(text != "").select("video_id", "id", text.alias("t")).withColumn("w", L.wrap_chinese(F.col("t")))
    same = F.regexp_replace("w", r"\s+", "") == F.regexp_replace("t", r"\s+", "")
    return rows.select("video_id", "id", same.alias("whole"), (F.size(F.split("w", "\n")) > 1).alias("wrapped"))


def split_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in up to three parts of 42 characters: words kept whole and in order."""
    text = R.squash(F.col("source_text"))
    rows = T.segments(spark, sf_dir).where(text != "").select("video_id", "id", text.alias("t")).withColumn("p", L.split_words(F.col("t"), 42, 3))
    return rows.select("video_id", "id", (F.array_join("p", " ") == F.col("t")).alias("whole"), (F.size("p") > 1).alias("parted"))


_UNIQUE = "e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY created_at DESC) AS _k FROM span_translation_examples) WHERE _k = 1)"
_KEY = "concat_ws('|', replace(lower(trim(project_id)), '_', '-'), span_id)"
_BLANK = "".join(f"CASE WHEN trim(coalesce({c}, '')) = '' THEN 'missing_{c}' END, " for c in ("project_id", "span_id", "source_joined", "translation_strategy"))
_NULL = "".join(f"CASE WHEN {c} IS NULL THEN 'missing_{c}' END, " for c in ("risk_reasons", "machine_target_by_id", "manual_target_by_id", "accepted", "use_for_span_prompt", "created_at"))
_OWN = lambda c: f"len(list_filter(map_keys({c}), lambda k: NOT list_contains(list_transform(coalesce(segment_ids, []), lambda x: CAST(x AS VARCHAR)), k))) > 0"
_VIOLATIONS = f"""{_UNIQUE}, v AS (SELECT example_id, rule FROM (SELECT example_id, unnest([{_BLANK}{_NULL}CASE WHEN len(coalesce(segment_ids, [])) = 0 THEN 'empty_segment_ids' END,
  CASE WHEN {_OWN('machine_target_by_id')} THEN 'machine_target_of_other_segment' END, CASE WHEN {_OWN('manual_target_by_id')} THEN 'manual_target_of_other_segment' END, CASE WHEN end_s <= start_s THEN 'end_not_after_start' END,
  CASE WHEN coalesce(use_for_span_prompt, false) AND NOT coalesce(accepted, false) THEN 'used_before_accepted' END]) AS rule FROM e) WHERE rule IS NOT NULL)"""
_FULL = _SPANS.replace("spans AS (SELECT video_id, start_id", "spans AS (SELECT video_id, chain || '-' || part AS span, ids, start_id")
_LOCKS = _WORDING["term_locks"]

QUERIES = {f.__name__: f for f in (
    record_violations, record_validation, gold_records, evaluation_sample, bulk_acceptance, style_profile, span_candidates, repair_clusters, display_issues, editor_rows, event_tails, job_states, wrapped_targets, split_sources,
)}

SQL = {
    "record_violations": f"WITH {_VIOLATIONS} SELECT * FROM v",
    "record_validation": f"WITH {_VIOLATIONS} SELECT count(*) AS n_records, count(DISTINCT {_KEY}) AS n_keys, count(*) - count(DISTINCT {_KEY}) AS n_repeated, (SELECT count(DISTINCT example_id) FROM v) AS n_invalid FROM e",
    "gold_records": f"WITH {_VIOLATIONS} SELECT example_id, record_key FROM (SELECT example_id, {_KEY} AS record_key, row_number() OVER (PARTITION BY {_KEY} ORDER BY created_at, example_id) AS k FROM e WHERE accepted AND NOT coalesce(use_for_span_prompt, false) AND example_id NOT IN (SELECT example_id FROM v)) WHERE k = 1",
    "evaluation_sample": f"WITH {_UNIQUE}, p AS (SELECT example_id, accepted, coalesce(accepted, false) AS kind, row_number() OVER (PARTITION BY coalesce(accepted, false) ORDER BY example_id) AS place FROM e) SELECT example_id, accepted FROM p ORDER BY place > 20, place, kind LIMIT 40",
    "bulk_acceptance": f"""WITH {_UNIQUE}, c AS (SELECT example_id FROM e WHERE risk_score < 8 AND NOT coalesce(accepted, false) ORDER BY example_id LIMIT 100)
SELECT example_id, CASE WHEN example_id IN (SELECT example_id FROM c) THEN true ELSE coalesce(accepted, false) END AS accepted, coalesce(use_for_span_prompt, false) AS use_for_span_prompt, example_id IN (SELECT example_id FROM c) AS updated FROM e""",
    "style_profile": f"""WITH {_UNIQUE}, k AS (SELECT translation_strategy AS strategy, machine_target_by_id AS a, manual_target_by_id AS b, unnest(list_distinct(list_concat(map_keys(machine_target_by_id), map_keys(manual_target_by_id)))) AS key FROM e),
p AS (SELECT strategy, {_SQ('a[key]')} AS machine, {_SQ('b[key]')} AS manual FROM k)
SELECT strategy, count(*) AS n, count_if(machine <> manual) AS n_changed, CAST(round(100 * avg(abs(length(manual) - length(machine)))) AS BIGINT) AS mean_delta_hundredths, count_if(length(manual) > length(machine)) AS n_longer, count_if(length(manual) < length(machine)) AS n_shorter FROM p WHERE machine <> '' AND manual <> '' GROUP BY 1""",
    "span_candidates": f"""WITH lk AS (SELECT video_id, id FROM ({_LOCKS})), sp AS ({_FULL} SELECT video_id, span, ids, start_id, risk_score FROM spans WHERE strategy IN ('span_first', 'span_context') AND n_segments <= 4 AND end_ms - start_ms <= 12000 AND risk_score >= 6),
i AS (SELECT *, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM sp), h AS (SELECT video_id, span, start_id, risk_score, string_agg(id, ',' ORDER BY pos) AS segment_ids FROM i WHERE (video_id, id) NOT IN (SELECT (video_id, id) FROM lk) GROUP BY 1, 2, 3, 4),
p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY risk_score DESC, start_id, span) AS place FROM h) SELECT video_id, segment_ids, risk_score, place FROM p WHERE place <= 16""",
    "repair_clusters": f"""{_FULL}, ss AS (SELECT video_id, span, least(start_id, end_id) AS a, greatest(start_id, end_id) AS b, risk_score AS score FROM spans),
rr AS (SELECT *, max(b) OVER (PARTITION BY video_id ORDER BY a, b, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ss), oo AS (SELECT *, coalesce(a - reach > 2, true) AS opens FROM rr),
xx AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w AS chain, last_value(CASE WHEN opens THEN a END IGNORE NULLS) OVER w AS first FROM oo WINDOW w AS (PARTITION BY video_id ORDER BY a, b, span ROWS UNBOUNDED PRECEDING))
SELECT video_id, min(a) AS first_id, max(b) AS last_id, count(*) AS n_spans, CAST(sum(score) AS BIGINT) AS score FROM xx GROUP BY video_id, chain, (a - first) // 24""",
    "display_issues": f"""WITH {T.CUES_SQL}, m AS (SELECT video_id, cue_id, end_ms - start_ms AS d, {_VL('zh_text')} AS n FROM cue WHERE end_ms > start_ms), k AS (SELECT *, CAST(ceil(n / 28) AS INT) AS want, least(CAST(ceil(n / 28) AS INT), 2) AS n_lines, n * 1000 / d AS cps FROM m WHERE n > 0),
l AS (SELECT *, CAST(ceil(n / n_lines) AS INT) AS line_length FROM k), i AS (SELECT *, list_filter([CASE WHEN want > 2 THEN 'too_many_lines' END, CASE WHEN line_length > 36 THEN 'line_too_long_hard' WHEN line_length > 33 THEN 'line_too_long_soft' END, CASE WHEN cps > 22 THEN 'cps_high_hard' WHEN cps > 18 THEN 'cps_high_soft' END], lambda x: x IS NOT NULL) AS f FROM l)
SELECT video_id, cue_id, n_lines, line_length, CAST(floor(cps * 100) AS BIGINT) AS cps_hundredths, array_to_string(f, ',') AS issues FROM i WHERE len(f) > 0""",
    "event_tails": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5",
    "job_states": """WITH u AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'view' THEN event_type END AS status, CASE WHEN event_type = 'view' THEN CAST(floor(value) AS INT) END AS progress, CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END AS completed_at FROM events)
SELECT user_id, arg_max(status, (ts, event_id)) FILTER (WHERE status IS NOT NULL) AS status, greatest(0, least(100, arg_max(progress, (ts, event_id)) FILTER (WHERE progress IS NOT NULL))) AS progress, min(completed_at) AS completed_at, count(*) AS n_updates FROM u GROUP BY 1""",
    "wrapped_targets": f"WITH {T.SEGMENTS_SQL}, t AS (SELECT video_id, id, {_SQ('target_text')} AS t FROM seg) SELECT video_id, id, true AS whole, {_VL('t')} > 28 AND len(regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9_./:\\\\+~#@%&=-]*|[.][A-Za-z0-9_./:\\\\+~#@%&=-]+|.')) > 1 AS wrapped FROM t WHERE t <> ''",
    "split_sources": f"WITH {T.SEGMENTS_SQL}, t AS (SELECT video_id, id, {_SQ('source_text')} AS t FROM seg) SELECT video_id, id, true AS whole, length(t) > 42 AND contains(t, ' ') AS parted FROM t WHERE t <> ''",
    "editor_rows": f"""WITH ti AS ({_WORDING['translation_issues']}), {T.SEGMENTS_SQL}, ck AS ({_CHECKS}),
f AS (SELECT video_id, id, r.code AS risk_type, CASE WHEN r.weight >= 4 THEN 'high' ELSE 'low' END AS severity, r.weight AS score, 1 AS feed FROM ({_RISK}) WHERE r IS NOT NULL
UNION ALL SELECT video_id, id, "check", 'medium', 3, 2 FROM ck UNION ALL SELECT video_id, id, CASE WHEN issue = 'text_pollution' THEN 'target_text_pollution' ELSE issue END, 'high', 5, 3 FROM ti)
SELECT video_id, id, risk_type, severity, CAST(score AS BIGINT) AS score, feed FROM (SELECT *, row_number() OVER (PARTITION BY video_id, id, risk_type ORDER BY feed, score DESC, severity) AS k FROM f) WHERE k = 1""",
}
