"""Queries on residue, scripts, repeats and merged terms, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan import tables as T
from reelspan.functions import rules as R
from reelspan.operators import residue as E
from reelspan.plans.quality_queries import _SQ, _ZH
from reelspan.runtime import read


def english_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latin runs left in Chinese targets, scored."""
    return E.residue(T.segments(spark, sf_dir), read(spark, sf_dir, "glossary_terms", "canonical", "policy", "priority"), read(spark, sf_dir, "entity_rules", "canonical_en"))


def residue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue by category and decision."""
    return english_residue(spark, sf_dir).groupBy("category", "decision").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("candidate").alias("n_candidates"))


def unwanted_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with unwanted scripts or broken encoding."""
    found = E.unwanted_scripts(F.col("target_text"))
    return T.segments(spark, sf_dir).where(F.size(found) > 0).select("video_id", "id", F.array_join(found, ",").alias("scripts"))


def repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that say a short phrase more than once."""
    said = E.repeated_phrases(F.col("source_text"))
    return T.segments(spark, sf_dir).where(F.size(said) > 0).select("video_id", "id", F.array_join(said, "|").alias("phrases"))


def merged_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the glossary and of the entity rules, merged by key."""
    terms = read(spark, sf_dir, "glossary_terms").select("canonical", "zh", "confidence", F.concat(F.coalesce("aliases", F.array()), F.coalesce("bad_aliases", F.array())).alias("aliases"), F.lit(1).alias("rank"))
    rules = read(spark, sf_dir, "entity_rules").select(F.col("canonical_en").alias("canonical"), F.col("canonical_zh").alias("zh"), F.lit(None).cast("double").alias("confidence"), F.col("surface_forms").alias("aliases"), F.lit(2).alias("rank"))
    return E.merge_terms(terms.unionByName(rules))


_KEY = lambda c: f"regexp_replace({_SQ(f'lower({c})')}, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')"
_SMALL = ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys((*R.OPEN_END_WORDS, *R.CONTINUATION_WORDS, *R.LEFT_MARKERS)))
_CAND = r"[A-Za-z][A-Za-z0-9_+./\\''-]*(?: [A-Za-z][A-Za-z0-9_+./\\''-]*)*"
_BASE = " ".join(f"WHEN '{c}' THEN {v}" for c, v in E.BASE_SCORES.items())
_RESIDUE = f"""
WITH {T.SEGMENTS_SQL}, known AS (SELECT key, max(k) AS k FROM (SELECT {_KEY('canonical')} AS key, CASE WHEN policy <> 'preserve' THEN 3 WHEN lower(priority) = 'hard' THEN 1 ELSE 2 END AS k FROM glossary_terms UNION ALL SELECT {_KEY('canonical_en')}, 3 FROM entity_rules) WHERE key <> '' GROUP BY 1),
c AS (SELECT video_id, id, source_text, unnest(list_distinct(regexp_extract_all(target_text, '{_CAND}'))) AS candidate FROM seg WHERE {_ZH('target_text')}),
m AS (SELECT c.*, {_KEY('candidate')} AS key, len(string_split(candidate, ' ')) AS w FROM c), j AS (SELECT m.*, k FROM m LEFT JOIN known USING (key)),
g AS (SELECT *, CASE WHEN k = 3 THEN 'known_translate_entity' WHEN k = 1 THEN 'explicit_preserve' WHEN regexp_matches(candidate, '[0-9_/\\\\]|[A-Za-z]\\.[A-Za-z]|[a-z][A-Z]') THEN 'code_or_identifier' WHEN k = 2 THEN 'glossary_soft_preserve'
  WHEN w = 1 AND key IN ({_SMALL}) THEN 'function_or_discourse' WHEN w = 1 AND regexp_matches(candidate, '^[A-Z][A-Z0-9.-]{{1,8}}$') THEN 'abbreviation' WHEN w > 1 AND NOT regexp_matches(candidate, '(^| )[^A-Z]') THEN 'proper_name'
  WHEN w = 1 AND regexp_matches(candidate, '^[A-Z]') THEN 'single_title_word' ELSE 'ordinary_english' END AS category FROM j),
s AS (SELECT *, greatest(0, (CASE category {_BASE} END) - CASE WHEN w = 1 AND category NOT IN ('explicit_preserve', 'code_or_identifier') THEN 25 ELSE 0 END) AS s0 FROM g),
t AS (SELECT *, CAST(CASE WHEN NOT coalesce(contains(lower(source_text), lower(candidate)), false) AND category <> 'explicit_preserve' THEN least(s0, 50) ELSE s0 END AS INT) AS score FROM s),
res AS (SELECT video_id, id, candidate, category, score, CASE WHEN score >= 85 THEN 'preserve' WHEN score >= 70 THEN 'review' ELSE 'translate' END AS decision FROM t)"""
_SCRIPTS = ", ".join(f"CASE WHEN regexp_matches(target_text, '[\\x{{{a:04x}}}-\\x{{{b:04x}}}]') THEN '{n}' END" for n, (a, b) in E.UNWANTED_SCRIPTS.items())

QUERIES = {f.__name__: f for f in (english_residue, residue_report, unwanted_scripts, repeated_phrases, merged_terms)}

SQL = {
    "english_residue": f"{_RESIDUE} SELECT * FROM res",
    "residue_report": f"{_RESIDUE} SELECT category, decision, count(*) AS n, count(DISTINCT candidate) AS n_candidates FROM res GROUP BY 1, 2",
    "unwanted_scripts": f"WITH {T.SEGMENTS_SQL}, s AS (SELECT video_id, id, list_filter([CASE WHEN regexp_matches(target_text, '\\x{{fffd}}|锟斤拷|â€') THEN 'broken encoding' END, {_SCRIPTS}], lambda x: x IS NOT NULL) AS f FROM seg) SELECT video_id, id, array_to_string(f, ',') AS scripts FROM s WHERE len(f) > 0",
    "repeated_phrases": f"""WITH {T.SEGMENTS_SQL}, p AS (SELECT video_id, id, list_filter(list_transform(regexp_split_to_array(coalesce(source_text, ''), '[.!?;,。！？；，]+'), lambda x: trim(regexp_replace(lower(x), '[^\\pL\\pN]+', ' ', 'g'))), lambda x: x <> '' AND len(string_split(x, ' ')) BETWEEN 2 AND 6) AS ps FROM seg),
r AS (SELECT video_id, id, list_sort(list_distinct(list_filter(ps, lambda x: len(list_filter(ps, lambda y: y = x)) > 1))) AS rs FROM p) SELECT video_id, id, array_to_string(rs, '|') AS phrases FROM r WHERE len(rs) > 0""",
    "merged_terms": f"""WITH t AS (SELECT canonical, zh, confidence, list_concat(coalesce(aliases, []), coalesce(bad_aliases, [])) AS aliases, 1 AS rank FROM glossary_terms UNION ALL SELECT canonical_en, canonical_zh, NULL, coalesce(surface_forms, []), 2 FROM entity_rules),
k AS (SELECT *, {_KEY('canonical')} AS key, list_transform(aliases, lambda a: {_SQ('a')}) AS al FROM t)
SELECT key, arg_min(canonical, (rank, canonical)) AS canonical, arg_min(zh, (rank, canonical)) FILTER (WHERE trim(zh) <> '') AS zh, max(confidence) AS confidence, count(DISTINCT rank) AS n_sources, array_to_string(list_sort(list_distinct(flatten(list(al)))), '|') AS aliases FROM k WHERE key <> '' GROUP BY 1""",
}
