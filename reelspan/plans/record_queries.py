"""Queries on terms, rules and feedback records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan import tables as T
from reelspan.functions import rules as R
from reelspan.operators import dictionary as D
from reelspan.operators import feedback as B
from reelspan.operators.overlap import best_overlap
from reelspan.operators.sequences import first_mentions
from reelspan.plans.correction_sql import corrected_sql
from reelspan.plans.quality_queries import _NUM, _SQ, _ZH
from reelspan.runtime import read


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "span_translation_examples")


def _unique_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.best_per_key(_examples(spark, sf_dir), F.col("example_id"), F.struct("created_at")).drop("_key")


def glossary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose source names a glossary term."""
    terms = read(spark, sf_dir, "glossary_terms", "term_id", "canonical")
    return D.term_hits(T.segments(spark, sf_dir), terms, ["video_id", "id"], "source_text", "canonical").select("video_id", "id", "term_id")


def glossary_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms used otherwise than the glossary says."""
    return D.consistency(T.segments(spark, sf_dir), read(spark, sf_dir, "glossary_terms", "term_id", "canonical", "bad_aliases", "zh", "policy"))


def alias_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values in which a bad alias is put right."""
    terms = read(spark, sf_dir, "glossary_terms", "canonical", "bad_aliases").select(F.explode("bad_aliases").alias("form"), F.col("canonical").alias("replacement"))
    return D.corrected(read(spark, sf_dir, "term_entries", "entry_id", "surface_form"), terms, ["entry_id"], "surface_form").select("entry_id", "after")


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First segment of each video, by time, that names each entity."""
    rules = read(spark, sf_dir, "entity_rules", "entity_key", "canonical_en")
    segs = T.timed(T.segments(spark, sf_dir))
    hits = D.term_hits(segs, rules, ["video_id", "id", "start_ms", "end_ms"], "source_text", "canonical_en")
    return first_mentions(hits.select("video_id", "entity_key", "id", "start_ms", "end_ms"), ["video_id", "entity_key"]).select("video_id", "entity_key", "id", "start_ms")


def entity_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that name entities, by type of entity."""
    rules = read(spark, sf_dir, "entity_rules", "entity_type", "canonical_en")
    hits = D.term_hits(T.segments(spark, sf_dir), rules, ["video_id", "id"], "source_text", "canonical_en")
    return hits.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("canonical_en").alias("n_entities"), F.countDistinct("video_id").alias("n_videos"))


def phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised phrases in English sources."""
    return D.phrase_counts(T.segments(spark, sf_dir), "source_text")


def near_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings, right and bad ones, that are easily taken for one another."""
    terms = read(spark, sf_dir, "glossary_terms", "canonical", "bad_aliases")
    forms = terms.select(F.explode(F.concat(F.array("canonical"), F.coalesce("bad_aliases", F.array()))).alias("form")).select(F.trim("form").alias("form")).distinct()
    return D.near_forms(forms, "form", "form")


def glossary_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of each term without untidy repeats, and how many there are by policy."""
    form = read(spark, sf_dir, "glossary_terms", "policy", "canonical", "aliases").select("policy", F.explode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array()))).alias("f"))
    return form.groupBy("policy").agg(F.count(F.lit(1)).alias("n_forms"), F.countDistinct(F.lower(R.squash(F.col("f")))).alias("n_distinct"))


def record_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span records kept once per key: accepted before not, meant for prompts before not, early before late."""
    rank = F.struct(F.coalesce("accepted", F.lit(False)).alias("a"), F.coalesce("use_for_span_prompt", F.lit(False)).alias("p"), (-F.unix_micros("created_at")).alias("t"), (-F.col("example_id")).alias("i"))
    return B.best_per_key(_examples(spark, sf_dir), B.record_key(), rank).select("example_id", "project_id", "span_id", F.col("_key").alias("record_key"))


def record_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate, conflicting and mergeable span records."""
    df = _unique_examples(spark, sf_dir)
    return B.same_and_different(df, F.col("source_joined"), B.map_text("machine_target_by_id"), B.map_text("manual_target_by_id"))


def prompt_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span records that may be shown as examples."""
    return B.prompt_examples(_unique_examples(spark, sf_dir)).select("example_id", "project_id", "span_id", "risk_score")


def reason_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk reasons of span records."""
    return B.reason_totals(_unique_examples(spark, sf_dir))


def strategy_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, acceptance, segments and score by strategy."""
    df = _unique_examples(spark, sf_dir)
    return df.groupBy("translation_strategy").agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("n_accepted"), F.sum(F.size("segment_ids")).alias("n_segments"), F.sum("risk_score").cast("bigint").alias("risk_sum"), F.countDistinct(F.lower(R.squash(F.col("project_id")))).alias("n_projects"))


def append_late_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the second half of the year that the first half lacks, by key."""
    df = _examples(spark, sf_dir)
    cut = F.to_timestamp(F.lit("2025-07-01 00:00:00"))
    return B.append_new(df.where(F.col("created_at") < cut), df.where(F.col("created_at") >= cut), B.record_key(), F.struct(F.unix_micros("created_at").alias("t"), "example_id")["example_id"]).select("example_id")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _unique_examples(spark, sf_dir)
    return df.select("example_id", "project_id", "risk_reasons", "translation_strategy", "segment_ids", F.round(F.col("duration") * 1000).cast("bigint").alias("duration_ms"), B.tokens(F.col("source_joined")).alias("words"))


def similar_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best examples for every span whose id is divisible by 100."""
    df = _scored(spark, sf_dir)
    return B.similar_examples(df.where("example_id % 100 = 0"), df)


def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the best examples come from the span's own project."""
    return B.ranking_quality(similar_examples(spark, sf_dir))


def edit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How manual lines differ from the machine targets they overlap most."""
    lines = T.timed(T.dialogues(spark, sf_dir)).where((F.col("layer") == 0) & R.has_chinese(F.col("text"))).select("video_id", "dialogue_id", "start_ms", "end_ms", T.clean_dialogue(F.col("text")).alias("manual"))
    left = T.timed(T.segments(spark, sf_dir)).select("video_id", "id", "start_ms", "end_ms", R.squash(F.col("target_text")).alias("machine"))
    best = best_overlap(left, lines, "video_id", ["video_id", "id"], "dialogue_id").select("l.machine", "r.manual").where("machine <> '' AND manual <> ''")
    return B.edit_summary(best)


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.timed(T.dialogues(spark, sf_dir)).where((F.col("layer") == 0) & R.has_chinese(F.col("text"))).select("video_id", "dialogue_id", "start_ms", "end_ms", T.clean_dialogue(F.col("text")).alias("manual"))
    left = T.timed(T.segments(spark, sf_dir)).select("video_id", "id", "start_ms", "end_ms", R.squash(F.col("target_text")).alias("machine"))
    return best_overlap(left, lines, "video_id", ["video_id", "id"], "dialogue_id").select("l.video_id", "l.id", "l.machine", "r.manual").where("machine <> '' AND manual <> ''")


def edit_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of edits between machine targets and manual lines, and in how many videos."""
    tagged = _edits(spark, sf_dir).select("video_id", F.explode(B.edit_tags(F.col("machine"), F.col("manual"))).alias("tag"))
    return tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("video_id").alias("n_videos"))


def merged_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a video of all its projects: earliest title and description, all authors."""
    meta = read(spark, sf_dir, "source_meta", "video_id", "project_id", "title", "description", "author", "published_at").distinct()
    return B.merge_candidates(meta, "video_id", ["published_at", "project_id"], ["title", "description"], ["author"])


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent source texts."""
    return B.top_counts(T.segments(spark, sf_dir), R.squash(F.col("source_text")), ["video_id", "id"], 20)


_LIT = lambda c: f"regexp_replace(lower({c}), '([.^$*+?()\\[\\]{{}}|\\\\-])', '\\\\\\1', 'g')"
_HAS = lambda text, term: f"(contains(lower({text}), lower({term})) AND regexp_matches(lower({text}), '(^|[^a-z0-9])' || {_LIT(term)} || '([^a-z0-9]|$)'))"
_MAP = lambda c: f"array_to_string(list_transform(list_sort(coalesce(map_keys({c}), [])), lambda k: k || ':' || coalesce({c}[k], '')), '|')"
_KEYSQL = f"coalesce(project_id, '') || '::' || coalesce(span_id, '') || '::' || array_to_string(coalesce(segment_ids, []), ',') || '::' || coalesce(source_joined, '') || '::' || {_MAP('manual_target_by_id')}"
_ONE = "ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY created_at DESC) AS _k FROM span_translation_examples) WHERE _k = 1)"
_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(source_joined), '[^\\pL\\pN]+'), lambda x: x <> ''))"
_SIM = f"""
WITH {_ONE}, d AS (SELECT example_id, project_id, coalesce(map_keys(risk_reasons), []) AS rk, translation_strategy AS st, len(coalesce(segment_ids, [])) AS ns, CAST(round(duration * 1000) AS BIGINT) AS ms, {_TOK} AS w FROM ex),
p AS (SELECT q.example_id AS query_id, e.example_id, q.project_id = e.project_id AS same_project, CAST(8 * len(list_intersect(q.rk, e.rk)) + CASE WHEN q.st = e.st THEN 10 ELSE 0 END
  + coalesce(floor(20 * len(list_intersect(q.w, e.w)) / nullif(len(list_distinct(list_concat(q.w, e.w))), 0)), 0) + greatest(0, 6 - 2 * abs(q.ns - e.ns)) + coalesce(greatest(0, 5 - abs(q.ms - e.ms) // 1000), 0) AS BIGINT) AS score
  FROM d q JOIN d e ON q.example_id % 100 = 0 AND q.example_id <> e.example_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_id) AS rank FROM p WHERE score > 0), ranked AS (SELECT query_id, rank, example_id, same_project, score FROM r WHERE rank <= 5)
"""

QUERIES = {f.__name__: f for f in (
    glossary_hits, glossary_consistency, alias_corrections, entity_mentions, entity_type_counts, phrase_counts, near_terms, glossary_forms, record_duplicates, record_conflicts,
    prompt_examples, reason_totals, strategy_acceptance, append_late_records, similar_examples, retrieval_quality, edit_summary, edit_tag_counts, merged_videos, top_sources,
)}

SQL = {
    "alias_corrections": corrected_sql("term_entries", "w AS (SELECT unnest(bad_aliases) AS form, canonical AS replacement FROM glossary_terms)", "entry_id", "surface_form", lead="WITH "),
    "glossary_hits": f"WITH {T.SEGMENTS_SQL} SELECT video_id, id, term_id FROM seg JOIN glossary_terms ON {_HAS('source_text', 'canonical')}",
    "glossary_consistency": f"""WITH {T.SEGMENTS_SQL}, g AS (SELECT * FROM glossary_terms WHERE length(trim(canonical)) >= 3), b AS (SELECT term_id, form FROM (SELECT term_id, unnest(bad_aliases) AS form FROM g) WHERE length(trim(form)) >= 3),
n AS (SELECT s.*, g.* EXCLUDE (confidence), {_HAS('s.target_text', 'g.canonical')} AS kept FROM seg s JOIN g ON {_HAS('s.source_text', 'g.canonical')} WHERE trim(s.target_text) <> '')
SELECT DISTINCT video_id, id, term_id, 'bad_alias_source' AS issue FROM seg JOIN b ON {_HAS('source_text', 'form')}
UNION ALL SELECT DISTINCT video_id, id, term_id, 'bad_alias_target' FROM seg JOIN b ON {_HAS('target_text', 'form')}
UNION ALL SELECT DISTINCT video_id, id, term_id, 'term_not_preserved' FROM n WHERE policy = 'preserve' AND NOT kept
UNION ALL SELECT DISTINCT video_id, id, term_id, 'term_not_translated' FROM n WHERE policy <> 'preserve' AND zh <> canonical AND kept AND NOT contains(target_text, regexp_replace(zh, '[《》]', '', 'g'))""",
    "entity_mentions": f"WITH {T.SEGMENTS_SQL} SELECT video_id, entity_key, id, start_ms FROM (SELECT video_id, entity_key, id, start_ms, row_number() OVER (PARTITION BY video_id, entity_key ORDER BY start_ms, end_ms, id) AS k FROM seg JOIN entity_rules ON {_HAS('source_text', 'canonical_en')} WHERE end_ms > start_ms) WHERE k = 1",
    "entity_type_counts": f"WITH {T.SEGMENTS_SQL} SELECT entity_type, count(*) AS n_mentions, count(DISTINCT canonical_en) AS n_entities, count(DISTINCT video_id) AS n_videos FROM seg JOIN entity_rules ON {_HAS('source_text', 'canonical_en')} GROUP BY 1",
    "phrase_counts": f"WITH {T.SEGMENTS_SQL}, p AS (SELECT unnest(regexp_extract_all(source_text, '[A-Z][a-z]+(?: [A-Z][a-z]+){{1,2}}')) AS phrase FROM seg) SELECT phrase, count(*) AS n, least(82, 45 + 5 * count(*)) AS confidence_pct FROM p GROUP BY 1 HAVING count(*) >= 2",
    "near_terms": "WITH f AS (SELECT DISTINCT trim(form) AS form FROM (SELECT unnest(list_concat([canonical], coalesce(bad_aliases, []))) AS form FROM glossary_terms)), w AS (SELECT form, string_split(lower(form), ' ') AS w FROM f) SELECT DISTINCT a.form AS id_a, b.form AS id_b FROM w a JOIN w b ON a.form < b.form AND len(a.w) = 2 AND len(b.w) = 2 AND ((a.w[1] = b.w[1] AND levenshtein(a.w[2], b.w[2]) <= 2) OR (a.w[2] = b.w[2] AND levenshtein(a.w[1], b.w[1]) <= 2))",
    "glossary_forms": f"WITH f AS (SELECT policy, unnest(list_distinct(list_concat([canonical], coalesce(aliases, [])))) AS f FROM glossary_terms) SELECT policy, count(*) AS n_forms, count(DISTINCT lower({_SQ('f')})) AS n_distinct FROM f GROUP BY 1",
    "record_duplicates": f"SELECT example_id, project_id, span_id, record_key FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY coalesce(accepted, false) DESC, coalesce(use_for_span_prompt, false) DESC, created_at, example_id) AS k FROM (SELECT *, {_KEYSQL} AS record_key FROM span_translation_examples)) WHERE k = 1",
    "record_conflicts": f"""WITH {_ONE}, r AS (SELECT lower({_SQ('source_joined')}) AS s, lower({_SQ(_MAP('machine_target_by_id'))}) AS m, lower({_SQ(_MAP('manual_target_by_id'))}) AS h FROM ex), x AS (SELECT * FROM r WHERE s <> '' OR m <> '' OR h <> '')
SELECT 'duplicate' AS kind, s AS source, m || ' => ' || h AS text, count(*) AS n_records, 1 AS n_variants FROM x GROUP BY s, m, h HAVING count(*) > 1
UNION ALL SELECT 'conflict', s, m, count(*), count(DISTINCT h) FROM x GROUP BY s, m HAVING count(DISTINCT h) > 1
UNION ALL SELECT 'merge', s, h, count(*), count(DISTINCT m) FROM x GROUP BY s, h HAVING count(DISTINCT m) > 1""",
    "prompt_examples": f"WITH {_ONE} SELECT example_id, project_id, span_id, risk_score FROM ex WHERE coalesce(accepted, false) AND coalesce(use_for_span_prompt, false) AND NOT coalesce(list_contains(quality_flags, 'bad_alignment'), false)",
    "reason_totals": f"WITH {_ONE}, e AS (SELECT unnest(map_entries(risk_reasons)) AS e FROM ex) SELECT e.key AS reason, count(*) AS n_records, CAST(sum(e.value) AS BIGINT) AS total FROM e GROUP BY 1",
    "strategy_acceptance": f"WITH {_ONE} SELECT translation_strategy, count(*) AS n, count_if(accepted) AS n_accepted, CAST(sum(len(segment_ids)) AS BIGINT) AS n_segments, CAST(sum(risk_score) AS BIGINT) AS risk_sum, count(DISTINCT lower({_SQ('project_id')})) AS n_projects FROM ex GROUP BY 1",
    "append_late_records": f"WITH k AS (SELECT *, {_KEYSQL} AS rk FROM span_translation_examples) SELECT min(example_id) AS example_id FROM k WHERE created_at >= TIMESTAMP '2025-07-01' AND rk NOT IN (SELECT rk FROM k WHERE created_at < TIMESTAMP '2025-07-01') GROUP BY rk",
    "similar_examples": f"{_SIM} SELECT * FROM ranked",
    "retrieval_quality": f"{_SIM}, f AS (SELECT query_id, min(CASE WHEN same_project THEN rank END) AS r FROM ranked GROUP BY 1) SELECT count(*) AS n_queries, CAST(coalesce(floor(count_if(coalesce(r <= 1, false)) * 1000000 / nullif(count(*), 0)), 0) AS BIGINT) AS recall_1_ppm, CAST(coalesce(floor(count_if(coalesce(r <= 3, false)) * 1000000 / nullif(count(*), 0)), 0) AS BIGINT) AS recall_3_ppm, CAST(coalesce(floor(count_if(coalesce(r <= 5, false)) * 1000000 / nullif(count(*), 0)), 0) AS BIGINT) AS recall_5_ppm, CAST(coalesce(floor(sum(coalesce(floor(1000000 / r), 0)) / nullif(count(*), 0)), 0) AS BIGINT) AS mrr_ppm FROM f",
    "edit_tag_counts": f"""WITH {T.SEGMENTS_SQL}, {T.DIALOGUES_SQL}, t AS (SELECT * FROM seg WHERE end_ms > start_ms), l AS (SELECT * FROM dlg WHERE layer = 0 AND end_ms > start_ms AND {_ZH('text')}),
p AS (SELECT t.video_id, t.id, l.dialogue_id, {_SQ('t.target_text')} AS machine, l.clean AS manual, t.end_ms - t.start_ms AS d, least(t.end_ms, l.end_ms) - greatest(t.start_ms, l.start_ms) AS o, l.start_ms AS ls FROM t JOIN l ON t.video_id = l.video_id AND t.start_ms < l.end_ms AND l.start_ms < t.end_ms),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id, id ORDER BY o DESC, ls, dialogue_id) AS k FROM p),
c AS (SELECT *, regexp_replace(lower(machine), '[^\\pL\\pN]+', '', 'g') AS x, regexp_replace(lower(manual), '[^\\pL\\pN]+', '', 'g') AS y FROM b WHERE k = 1 AND o >= 0.35 * d AND machine <> '' AND manual <> ''),
tg AS (SELECT video_id, unnest([CASE WHEN machine = manual THEN 'unchanged' END, CASE WHEN machine <> manual AND x = y THEN 'surface' END, CASE WHEN machine <> manual AND length(y) * 5 <= length(x) * 4 THEN 'compressed' END, CASE WHEN machine <> manual AND length(y) * 4 >= length(x) * 5 THEN 'expanded' END,
  CASE WHEN list_sort({_NUM('machine')}) <> list_sort({_NUM('manual')}) THEN 'numbers' END, CASE WHEN regexp_matches(machine, '[A-Za-z]{{2}}') AND NOT regexp_matches(manual, '[A-Za-z]{{2}}') THEN 'latin' END]) AS tag FROM c)
SELECT tag, count(*) AS n, count(DISTINCT video_id) AS n_videos FROM tg WHERE tag IS NOT NULL GROUP BY 1""",
    "merged_videos": """WITH m AS (SELECT DISTINCT video_id, project_id, title, description, author, published_at FROM source_meta)
SELECT video_id, count(*) AS n_rows, arg_min(trim(title), (published_at, project_id, trim(title))) FILTER (WHERE trim(title) <> '') AS title, arg_min(trim(description), (published_at, project_id, trim(description))) FILTER (WHERE trim(description) <> '') AS description,
coalesce(array_to_string(list_sort(list(DISTINCT trim(author)) FILTER (WHERE trim(author) <> '')), '|'), '') AS all_author FROM m GROUP BY 1""",
    "top_sources": f"WITH {T.SEGMENTS_SQL}, v AS (SELECT {_SQ('source_text')} AS value, video_id, id FROM seg) SELECT value, count(*) AS n FROM v WHERE value <> '' GROUP BY 1 ORDER BY n DESC, min((video_id, id)) LIMIT 20",
    "edit_summary": f"""WITH {T.SEGMENTS_SQL}, {T.DIALOGUES_SQL}, t AS (SELECT * FROM seg WHERE end_ms > start_ms), l AS (SELECT * FROM dlg WHERE layer = 0 AND end_ms > start_ms AND {_ZH('text')}),
p AS (SELECT t.video_id, t.id, l.dialogue_id, {_SQ('t.target_text')} AS machine, l.clean AS manual, t.end_ms - t.start_ms AS d, least(t.end_ms, l.end_ms) - greatest(t.start_ms, l.start_ms) AS o, l.start_ms AS ls FROM t JOIN l ON t.video_id = l.video_id AND t.start_ms < l.end_ms AND l.start_ms < t.end_ms),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id, id ORDER BY o DESC, ls, dialogue_id) AS k FROM p),
c AS (SELECT *, regexp_replace(machine, '[\\s\\pZ]+', '', 'g') AS x, regexp_replace(manual, '[\\s\\pZ]+', '', 'g') AS y FROM b WHERE k = 1 AND o >= 0.35 * d AND machine <> '' AND manual <> ''),
s AS (SELECT *, list_sum(list_transform(list_distinct(string_split(x, '')), lambda ch: least(length(x) - length(replace(x, ch, '')), length(y) - length(replace(y, ch, ''))))) AS shared FROM c)
SELECT count(*) AS n_pairs, count_if(machine <> manual) AS n_changed, count_if(machine <> manual AND regexp_replace(lower(machine), '[^\\pL\\pN]+', '', 'g') = regexp_replace(lower(manual), '[^\\pL\\pN]+', '', 'g')) AS n_surface_only,
CAST(sum(floor(coalesce(shared, 0) / greatest(length(x), length(y)) * 10000)) AS BIGINT) AS similarity_sum_e4, CAST(sum(abs(length(machine) - length(manual))) AS BIGINT) AS abs_delta_sum FROM s""",
}
