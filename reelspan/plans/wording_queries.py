"""Queries on wording, terms, allocation and tails, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan import tables as T
from reelspan.functions import rules as R
from reelspan.functions import wording as W
from reelspan.operators import allocation as A
from reelspan.operators import quality as Q
from reelspan.operators import tails as O
from reelspan.operators import terminology as G
from reelspan.plans.correction_sql import corrected_sql
from reelspan.plans.quality_queries import _CONT, _END, _LEAVES, _OPEN, _POLLUTED, _RISK, _SPANS, _SQ, _VL, _ZH
from reelspan.runtime import read


def wording_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each segment whether its source has something to translate, its sentences, and the pieces of its target."""
    return T.segments(spark, sf_dir).select("video_id", "id", W.translatable(F.col("source_text")).alias("translatable"), W.sentence_count(F.col("source_text")).alias("n_sentences"), F.size(W.meaning_chunks(F.col("target_text"))).alias("n_chunks"))


def mixed_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of targets, Latin ones whole, by how often they occur; blanks aside."""
    tokens = T.segments(spark, sf_dir).select(F.explode(W.mixed_tokens(F.col("target_text"))).alias("token"))
    return tokens.where("token rlike '[A-Za-z0-9]'").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def title_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects' titles cleaned, their capitalised phrases, their video's key and a name for files."""
    meta = read(spark, sf_dir, "source_meta", "project_id", "title", "url").distinct()
    return meta.select("project_id", "title", W.clean_title(F.col("title")).alias("clean"), F.array_join(W.proper_phrases(F.col("title")), "|").alias("phrases"), W.video_key(F.col("url")).alias("video_key"), W.slug(F.col("title")).alias("slug"), W.first_person(F.lower("title")).alias("spoken"))


def term_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that are just a term of the glossary, with the target its policy wants."""
    return G.lock_terms(T.timed(T.segments(spark, sf_dir)), read(spark, sf_dir, "glossary_terms"))


def preserved_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that are just a preserved term."""
    return G.preserved_only(T.segments(spark, sf_dir), read(spark, sf_dir, "glossary_terms", "canonical", "policy"), ["video_id", "id"], "source_text")


def left_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets in which terms to be translated were left, put right."""
    return G.translate_left_terms(T.segments(spark, sf_dir), read(spark, sf_dir, "glossary_terms")).select("video_id", "id", "after")


def repaired_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with bad spellings of terms put right."""
    return G.repair_sources(T.segments(spark, sf_dir, "words"), read(spark, sf_dir, "glossary_terms", "canonical", "bad_aliases")).select("video_id", "id", "after")


def allocation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the translations of timed segments fall on them: flags, confidence, status."""
    segs = T.timed(T.segments(spark, sf_dir))
    spans = Q.source_spans(segs).select("video_id", "span", "segment_ids", "n_segments", "risk_score", "start_id")
    return A.allocation(segs, spans).select("video_id", "id", "span_segments", F.array_join("flags", ",").alias("flags"), F.round(F.col("confidence") * 100).cast("int").alias("confidence_pct"), "status")


def allocation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by flag."""
    return allocation_flags(spark, sf_dir).select(F.explode(F.split("flags", ",")).alias("flag"), "status").where("flag <> ''").groupBy("flag", "status").agg(F.count(F.lit(1)).alias("n"))


def translation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cues of the videos that have some say for each segment, held against the segments' sources."""
    cues = T.cues(spark, sf_dir).where("source_segment_id IS NOT NULL").groupBy("video_id", F.col("source_segment_id").alias("id")).agg(F.min("zh_text").alias("target"))
    asked = T.segments(spark, sf_dir).select("video_id", "id", F.col("source_text").alias("source")).join(cues.select("video_id").distinct(), "video_id", "left_semi")
    return A.translation_issues(asked, cues, ["video_id", "id"])


def cue_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short tails among cues, by what they are to the cue before them."""
    return O.tail_kinds(T.timed(T.cues(spark, sf_dir))).where("kind <> 'not_terminal_short'")


def joined_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with orphaned tails joined to what they end."""
    return O.join_tails(T.timed(T.cues(spark, sf_dir)))


def segmentation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation of each video with cues in counts."""
    return O.segmentation_metrics(T.segments(spark, sf_dir), T.timed(T.cues(spark, sf_dir)))


def difficult_span_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos by whether a segment's own faults would stop their output."""
    segs = T.segments(spark, sf_dir)
    codes = Q.risk_codes(F.col("source_text"), F.col("target_text"), F.col("start_ms"), F.col("end_ms"))
    counts = F.map_from_entries(F.transform(codes, lambda c: F.struct(c.code, F.lit(1))))
    return segs.groupBy("video_id").agg(F.count_if(A.blocking_span(counts, F.lit("high"))).alias("n_blocking"), F.count(F.lit(1)).alias("n_segments"))


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_WORDS = lambda c: f"list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z]{{2,}}'), lambda w: lower(w))"
_TRANSLATABLE = lambda c: f"""(regexp_matches(coalesce({c}, ''), '[\\x{{0400}}-\\x{{052f}}]') OR regexp_matches(coalesce({c}, ''), '(?:^|[^A-Za-z])[iI](?:$|[^A-Za-z0-9_])') OR list_has_any({_WORDS(c)}, {_LIST(W.TRANSLATABLE_WORDS)})
  OR (len({_WORDS(c)}) >= 2 AND ((regexp_matches(coalesce({c}, ''), '[.!?]') AND len({_WORDS(c)}) >= 3) OR len({_WORDS(c)}) >= 7)))"""  # noqa: E731
_SENTENCES = lambda c: f"len(list_filter(regexp_split_to_array(regexp_replace({_SQ(c)}, '\\b(Mr|Dr|Ms|Mrs|e\\.g|i\\.e)\\.', '\\1', 'g'), '[.!?] +'), lambda p: trim(p) <> ''))"
_DOTS = lambda c: f"regexp_replace({c}, '([\\pL\\pN])\\.([\\pL\\pN])', '\\1' || chr(1) || '\\2', 'g')"
_CHUNKS = lambda c: f"len(list_filter(string_split(regexp_replace(regexp_replace({_DOTS(_DOTS(_SQ(c)))}, '(\\pL):([\\\\/])', '\\1' || chr(2) || '\\2', 'g'), '([，,、；;：:。.!！？?]) ?', '\\1' || chr(3), 'g'), chr(3)), lambda p: trim(p) <> ''))"
_TERM_KEY = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^\\pL\\pN]+', '', 'g')"
_PURE = lambda c: _TERM_KEY(f"regexp_replace(regexp_replace(regexp_replace({_SQ(c)}, '^[\\pP\\pS ]+|[\\pP\\pS ]+$', '', 'g'), '(?i)^(the|a|an) +', ''), '(?i)(''s|s'')$', '')")
_TAIL = lambda c: f"list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9'']+'), lambda w: lower(w))"
_STOPS = lambda c: f"regexp_matches(trim(coalesce({c}, '')), '[.!?][\"'')\\]]*$')"
_KIND = lambda left, right, gap: f"""CASE WHEN trim({right}) = '' OR len({_TAIL(right)}) > 2 OR NOT {_STOPS(right)} THEN 'not_terminal_short'
  WHEN len({_TAIL(left)}) > 0 AND (NOT {_STOPS(left)} OR list_contains({_LIST(W.OPEN_TAIL_WORDS)}, {_TAIL(left)}[-1])) THEN 'content_tail'
  WHEN list_contains({_LIST(W.STRONG_PARTICLES)}, array_to_string({_TAIL(right)}, ' ')) THEN CASE WHEN {gap} IS NULL OR {gap} >= 180 THEN 'standalone_particle' ELSE 'ambiguous_particle' END
  WHEN trim(coalesce({left}, '')) LIKE '%?' AND list_contains({_LIST(W.QUESTION_RESPONSES)}, {_TAIL(right)}[1]) THEN 'standalone_particle'
  WHEN list_contains({_LIST(W.AMBIGUOUS_PARTICLES)}, array_to_string({_TAIL(right)}, ' ')) THEN 'ambiguous_particle' WHEN regexp_matches(trim({right}), '^\\p{{Ll}}') THEN 'content_tail' ELSE 'not_terminal_short' END"""  # noqa: E731
_CUES = f"{T.CUES_SQL}, q AS (SELECT video_id, cue_id, start_ms, end_ms, {_SQ('en_text')} AS en, {_SQ('zh_text')} AS zh FROM cue WHERE end_ms > start_ms)"
_CUE_ORDER = "ORDER BY start_ms, end_ms, cue_id"
_RULES = f"""r AS (SELECT term_id, {_SQ('canonical')} AS canonical, CASE WHEN {_SQ('zh')} <> '' THEN {_SQ('zh')} ELSE {_SQ('canonical')} END AS zh, CASE WHEN trim(coalesce(policy, '')) <> '' THEN trim(policy) ELSE 'preserve' END AS policy,
  {_SQ('short_name')} AS short_name, lower(coalesce(priority, '')) = 'hard' AS hard, list_concat([canonical], coalesce(aliases, []), coalesce(bad_aliases, [])) AS spelled FROM glossary_terms WHERE length({_SQ('canonical')}) >= 2),
f AS (SELECT DISTINCT * EXCLUDE (spelled, form), {_PURE('form')} AS form FROM (SELECT *, unnest(list_concat(spelled, [zh])) AS form FROM r)),
u AS (SELECT * FROM f WHERE form <> '' AND (policy IN ('translate', 'mixed') OR (policy IN ('preserve', 'preserve_en') AND (hard OR regexp_matches(canonical, '[0-9_/\\\\]|[A-Za-z]\\.[A-Za-z]|[a-z][A-Z]')))))"""
_LEFT_RULES = f"""g AS (SELECT trim(zh) AS replacement, unnest(list_transform(list_concat([canonical], coalesce(aliases, []), coalesce(bad_aliases, [])), lambda f: {_SQ('f')})) AS form FROM glossary_terms WHERE trim(policy) = 'translate' AND trim(zh) <> ''),
w AS (SELECT min(form) AS form, replacement FROM g WHERE length(form) >= 2 AND form <> replacement GROUP BY lower(form), replacement)"""
_REPAIR_RULES = f"""g AS (SELECT {_SQ('canonical')} AS replacement, unnest(list_transform(bad_aliases, lambda f: {_SQ('f')})) AS form FROM glossary_terms WHERE length({_SQ('canonical')}) >= 3),
w AS (SELECT DISTINCT form, replacement FROM g WHERE length(form) >= 3 AND lower(form) <> lower(replacement))"""
_ALLOCATION = f"""
{_SPANS.replace("spans AS (SELECT video_id, start_id", "spans AS (SELECT video_id, chain, part, ids, start_id")},
top AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY risk_score DESC, start_id, chain || '-' || part) AS k FROM spans), o AS (SELECT video_id, unnest(ids) AS id, n_segments AS span_segments FROM top WHERE k <= 16),
x AS (SELECT seg.video_id, seg.id, start_ms, end_ms, {_SQ('source_text')} AS s, {_SQ('target_text')} AS t, coalesce(span_segments, 1) AS span_segments FROM seg LEFT JOIN o ON o.video_id = seg.video_id AND o.id = seg.id WHERE end_ms > start_ms),
y AS (SELECT *, {_ZH('t')} AS zh, last_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM x),
z AS (SELECT *, list_sort(list_filter(list_concat(CASE WHEN t = '' THEN ['empty_target'] ELSE [CASE WHEN NOT zh AND regexp_matches(s, '[A-Za-z]') THEN 'target_without_chinese' END,
  CASE WHEN regexp_matches(t, '({"|".join(W.OPEN_ALLOCATION_ENDS)})$') THEN 'target_open_ending' END, CASE WHEN {_VL('t')} <= 3 AND {_VL('s')} >= 18 THEN 'target_too_short' END, CASE WHEN {_LEAVES} THEN 'short_english_leak' END,
  CASE WHEN {_SENTENCES('s')} >= 2 AND {_CHUNKS('t')} >= 2 THEN 'possible_two_sentence_target' END, CASE WHEN span_segments >= 2 AND NOT {_END('s')} AND regexp_matches(t, '[。！？]$') THEN 'closed_translation_for_open_source' END] END,
  CASE WHEN coalesce(t <> '' AND t = last, false) THEN ['adjacent_duplicate_target'] ELSE [] END), lambda f: f IS NOT NULL)) AS fl FROM y),
alloc AS (SELECT video_id, id, CAST(span_segments AS BIGINT) AS span_segments, array_to_string(fl, ',') AS flags, CAST(round(greatest(5.0, 76 - least(55.0, 12 * len(fl)))) AS INT) AS confidence_pct, CASE WHEN t <> '' AND greatest(5.0, 76 - least(55.0, 12 * len(fl))) >= 58 THEN 'applied' ELSE 'review' END AS status FROM z)"""
_JOINED = "trim(concat_ws(' ', nullif(en, ''), nullif(n_en, '')))"
_PART = lambda k: f"regexp_extract(zz, '^(.*[。！？])([^。！？]{{2,10}})([。！？])$', {k})"

QUERIES = {f.__name__: f for f in (
    wording_marks, mixed_token_counts, title_parts, term_locks, preserved_cues, left_terms, repaired_sources, allocation_flags, allocation_summary, translation_issues, cue_tails, joined_tails, segmentation_metrics, difficult_span_gate,
)}

SQL = {
    "wording_marks": f"WITH {T.SEGMENTS_SQL} SELECT video_id, id, {_TRANSLATABLE('source_text')} AS translatable, {_SENTENCES('source_text')} AS n_sentences, {_CHUNKS('target_text')} AS n_chunks FROM seg",
    "mixed_token_counts": f"WITH {T.SEGMENTS_SQL}, t AS (SELECT unnest(regexp_extract_all(coalesce(target_text, ''), '(?s)[A-Za-z0-9][A-Za-z0-9_./:\\\\+~#@%&=-]*|[.][A-Za-z0-9_./:\\\\+~#@%&=-]+|\\s+|.')) AS token FROM seg) SELECT token, count(*) AS n FROM t WHERE regexp_matches(token, '[A-Za-z0-9]') GROUP BY 1",
    "title_parts": f"""WITH m AS (SELECT DISTINCT project_id, title, url FROM source_meta),
p AS (SELECT *, list_filter(regexp_extract_all(coalesce(title, ''), '\\b([A-Z][A-Za-z0-9''-]+(?:\\s+[A-Z][A-Za-z0-9''-]+){{0,3}})'), lambda x: lower(x) <> 'youtube') AS ps FROM m),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '[\\[(（【].*?[\\])）】]', ' ', 'g'), '(?i)\\b(ep|episode|part|pt|p) *[.#:-]? *[0-9]+\\b', ' ', 'g'), '\\b[0-9]+ */ *[0-9]+\\b', ' ', 'g') AS c1 FROM p)
SELECT project_id, title, {_SQ("regexp_replace(c1, '[^\\pL\\pN_\\s''-]+', ' ', 'g')")} AS clean, array_to_string(list_filter(ps, lambda x, i: list_position(list_transform(ps, lambda y: lower(y)), lower(x)) = i)[1:5], '|') AS phrases,
  CASE WHEN regexp_extract(url, '[?&]v=([A-Za-z0-9_-]{{6,}})', 1) <> '' THEN regexp_extract(url, '[?&]v=([A-Za-z0-9_-]{{6,}})', 1) WHEN regexp_extract(url, 'youtu\\.be/([A-Za-z0-9_-]{{6,}})', 1) <> '' THEN regexp_extract(url, 'youtu\\.be/([A-Za-z0-9_-]{{6,}})', 1) ELSE coalesce(regexp_extract(url, 'youtube\\.com/shorts/([A-Za-z0-9_-]{{6,}})', 1), '') END AS video_key,
  left(regexp_replace(regexp_replace(trim(coalesce(title, '')), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 80) AS slug, regexp_replace(lower(title), '\\bi\\b', 'I', 'g') AS spoken FROM c""",
    "term_locks": f"""WITH {T.SEGMENTS_SQL}, {_RULES}, b AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY hard DESC, length(canonical) DESC, canonical, term_id, zh, policy, short_name) AS k FROM u),
m AS (SELECT video_id, id, term_id, canonical, zh, policy, short_name, row_number() OVER (PARTITION BY video_id, term_id ORDER BY start_ms, end_ms, id) = 1 AS first_mention FROM (SELECT *, {_PURE('source_text')} AS form FROM seg WHERE end_ms > start_ms) JOIN (SELECT * FROM b WHERE k = 1) USING (form))
SELECT video_id, id, term_id, policy, first_mention, CASE policy WHEN 'translate' THEN zh WHEN 'mixed' THEN CASE WHEN first_mention AND {_TERM_KEY('zh')} <> {_TERM_KEY('canonical')} THEN zh || '（' || canonical || '）' WHEN short_name <> '' THEN short_name ELSE zh END ELSE canonical END AS target FROM m""",
    "preserved_cues": f"WITH {T.SEGMENTS_SQL}, k AS (SELECT {_TERM_KEY('canonical')} AS k, min(trim(canonical)) AS canonical FROM glossary_terms WHERE trim(policy) = 'preserve' GROUP BY 1) SELECT video_id, id, canonical FROM seg JOIN k ON k.k = {_TERM_KEY('source_text')} WHERE k.k <> ''",
    "left_terms": f"WITH {T.SEGMENTS_SQL}, " + corrected_sql("seg", _LEFT_RULES, "video_id, id", "target_text"),
    "repaired_sources": f"WITH {T.SEGMENTS_SQL}, " + corrected_sql("seg", _REPAIR_RULES, "video_id, id", "source_text"),
    "allocation_flags": f"{_ALLOCATION} SELECT * FROM alloc",
    "allocation_summary": f"{_ALLOCATION} SELECT flag, status, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag, status FROM alloc) WHERE flag <> '' GROUP BY 1, 2",
    "translation_issues": f"""WITH {T.SEGMENTS_SQL}, {T.CUES_SQL}, c AS (SELECT video_id, source_segment_id AS id, min(zh_text) AS target, true AS given FROM cue WHERE source_segment_id IS NOT NULL GROUP BY 1, 2),
a AS (SELECT video_id, id, source_text AS source, true AS asked FROM seg WHERE video_id IN (SELECT video_id FROM c)), b AS (SELECT video_id, id, source, target, coalesce(asked, false) AS asked, coalesce(given, false) AS given, {_SQ('source')} AS s, {_SQ('target')} AS t, {_ZH('target')} AS zh FROM a FULL JOIN c USING (video_id, id))
SELECT video_id, id, issue FROM (SELECT video_id, id, unnest([CASE WHEN asked AND NOT given THEN 'missing' END, CASE WHEN given AND NOT asked THEN 'extra' END, CASE WHEN asked AND given AND t = '' THEN 'empty' END,
  CASE WHEN asked AND given AND t <> '' AND lower(regexp_replace(s, '[\\pP\\pS\\pZ\\s]+', '', 'g')) = lower(regexp_replace(t, '[\\pP\\pS\\pZ\\s]+', '', 'g')) AND {_TRANSLATABLE('s')} THEN 'source_echo' END, CASE WHEN asked AND given AND t <> '' AND NOT zh AND {_TRANSLATABLE('s')} THEN 'target_without_chinese' END,
  CASE WHEN asked AND given AND t <> '' AND ({_POLLUTED}) THEN 'text_pollution' END, CASE WHEN asked AND given AND t <> '' AND {_LEAVES} THEN 'short_english_leak' END]) AS issue FROM b) WHERE issue IS NOT NULL""",
    "difficult_span_gate": f"""WITH {T.SEGMENTS_SQL}, c AS (SELECT video_id, id, list(r.code) AS cs FROM ({_RISK}) WHERE r IS NOT NULL GROUP BY 1, 2)
SELECT seg.video_id, count_if(coalesce(list_contains(cs, 'target_text_pollution') OR (list_contains(cs, 'target_too_short') AND list_has_any(cs, ['target_open_ending', 'source_starts_with_continuation', 'source_ends_with_open_word'])), false)) AS n_blocking, count(*) AS n_segments
FROM seg LEFT JOIN c ON c.video_id = seg.video_id AND c.id = seg.id GROUP BY 1""",
    "cue_tails": f"WITH {_CUES}, n AS (SELECT *, lag(en) OVER w AS p, greatest(start_ms - lag(end_ms) OVER w, 0) AS gap0, lag(end_ms) OVER w AS pe FROM q WINDOW w AS (PARTITION BY video_id {_CUE_ORDER})), k AS (SELECT video_id, cue_id, {_KIND('p', 'en', '(CASE WHEN pe IS NOT NULL THEN gap0 END)')} AS kind FROM n) SELECT * FROM k WHERE kind <> 'not_terminal_short'",
    "joined_tails": f"""WITH {_CUES}, n AS (SELECT *, lead(cue_id) OVER w AS n_id, lead(start_ms) OVER w AS n_start, lead(end_ms) OVER w AS n_end, lead(en) OVER w AS n_en, lead(zh) OVER w AS n_zh, row_number() OVER w AS rn FROM q WINDOW w AS (PARTITION BY video_id {_CUE_ORDER})),
g AS (SELECT *, coalesce(n_id IS NOT NULL AND {_KIND('en', 'n_en', 'greatest(n_start - end_ms, 0)')} = 'content_tail' AND greatest(n_start - end_ms, 0) <= 1200 AND greatest(n_end - start_ms, 0) <= 7700 AND {_VL(_JOINED)} <= 92, false) AS fits FROM n),
s AS (SELECT *, coalesce(last_value(CASE WHEN NOT fits THEN rn END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop FROM g),
k AS (SELECT *, fits AND (rn - stop) % 2 = 1 AS takes FROM s), a AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY video_id ORDER BY rn), false) AS gone, regexp_replace({_SQ('zh || n_zh')}, '([一-龥])[。，]([一-龥]{{1,4}}。)$', '\\1\\2') AS zz FROM k)
SELECT video_id, cue_id, CASE WHEN takes THEN n_id END AS tail_id, start_ms, CASE WHEN takes THEN n_end ELSE end_ms END AS end_ms, CASE WHEN takes THEN regexp_replace({_JOINED}, '([A-Za-z])\\. +([a-z][A-Za-z0-9''-]*(?: +[a-z][A-Za-z0-9''-]*)?[.!?])$', '\\1 \\2') ELSE en END AS en_text,
CASE WHEN NOT takes THEN zh WHEN {_PART(2)} <> '' AND contains({_PART(1)}, {_PART(2)}) THEN regexp_replace({_PART(1)}, '[。！？]+$', '') || {_PART(3)} ELSE zz END AS zh_text FROM a WHERE NOT gone""",
    "segmentation_metrics": f"""WITH {T.SEGMENTS_SQL}, {_CUES}, s1 AS (SELECT *, {_SQ('source_text')} AS s FROM seg), s2 AS (SELECT video_id, count(*) AS n_segments, count_if(s <> '' AND NOT {_END('s')} AND len(regexp_extract_all(s, '[A-Za-z0-9'']+')) <= 5) AS n_short_fragment,
  count_if(regexp_matches(s, '[a-z0-9][.!?] +[A-Z0-9]')) AS n_mixed_sentence, count_if({_CONT('s')} OR {_OPEN('s')}) AS n_function_edge FROM s1 GROUP BY 1),
n AS (SELECT *, lag(en) OVER w AS p, greatest(start_ms - lag(end_ms) OVER w, 0) AS gap0, lag(end_ms) OVER w AS pe FROM q WINDOW w AS (PARTITION BY video_id {_CUE_ORDER})), k AS (SELECT *, {_KIND('p', 'en', '(CASE WHEN pe IS NOT NULL THEN gap0 END)')} AS kind FROM n),
c2 AS (SELECT video_id, count(*) AS n_cues, count_if(end_ms - start_ms < 700) AS n_too_short, count_if(end_ms - start_ms > 6950) AS n_too_long, count_if(kind = 'content_tail') AS n_content_tail, count_if(kind = 'standalone_particle') AS n_standalone_particle, count_if(kind = 'ambiguous_particle') AS n_ambiguous_particle FROM k GROUP BY 1)
SELECT * FROM s2 JOIN c2 USING (video_id)""",
}
