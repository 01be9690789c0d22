"""Terms as a glossary wants them: cues that are just a term, translated terms put in, sources put right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions import rules as R
from reelspan.functions.wording import pure_term, term_key
from reelspan.operators.dictionary import corrected
from reelspan.operators.sequences import first_mentions


def term_rules(glossary: DataFrame) -> DataFrame:
    """``form, term_id, canonical, zh, policy, short_name, rank``: every pure form of each term of two letters or more. Hard terms rank first, then longer ones, then names."""
    tidy = lambda c: R.squash(F.col(c))
    rows = glossary.where(F.length(tidy("canonical")) >= 2)
    zh = F.when(tidy("zh") != "", tidy("zh")).otherwise(tidy("canonical"))
    policy = F.when(F.trim(F.coalesce("policy", F.lit(""))) != "", F.trim("policy")).otherwise("preserve")
    forms = F.concat(F.array(F.col("canonical"), zh), F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("bad_aliases", F.array().cast("array<string>")))
    hard = F.lower(F.coalesce("priority", F.lit(""))) == "hard"
    rank = F.struct((~hard).alias("soft"), (-F.length(tidy("canonical"))).alias("short"), tidy("canonical").alias("name"))
    out = rows.select("term_id", tidy("canonical").alias("canonical"), zh.alias("zh"), policy.alias("policy"), tidy("short_name").alias("short_name"), hard.alias("hard"), rank.alias("rank"), F.explode(F.array_distinct(F.transform(forms, pure_term))).alias("form"))
    return out.where("form <> ''")


def _kept(rule: Column) -> Column:
    """A preserved term may be locked if its rule is hard or it looks like code."""
    return rule["hard"] | F.rlike(rule["canonical"], F.lit(r"[0-9_/\\]|[A-Za-z]\.[A-Za-z]|[a-z][A-Z]"))


def lock_terms(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """``video_id, id, term_id, policy, first_mention, target``: segments whose source is just a term, with the target that its policy wants.

    The source's pure form is joined to those of the terms; of several the first rule that may be used holds. Preserved terms are only locked if the
    rule is hard or the term looks like code. Of a term with policy 'mixed' the first mention in a video, by time, is 'zh（canonical）', later ones are the
    short name. First mentions are minima with partial aggregation.
    """
    rules = term_rules(glossary)
    usable = rules.where(F.col("policy").isin("translate", "mixed") | (F.col("policy").isin("preserve", "preserve_en") & _kept(F.struct("hard", "canonical"))))
    best = usable.groupBy("form").agg(F.min(F.struct("rank", "term_id", "canonical", "zh", "policy", "short_name")).alias("r"))
    met = segments.withColumn("form", pure_term(F.col("source_text"))).where("form <> ''").join(best, "form").select("video_id", "id", "start_ms", "end_ms", "r.*")
    first = first_mentions(met.select("video_id", "term_id", "start_ms", "end_ms", "id"), ["video_id", "term_id"]).select("video_id", "term_id", F.col("id").alias("_first"))
    met = met.join(first, ["video_id", "term_id"]).withColumn("first_mention", F.col("id") == F.col("_first"))
    both = F.concat(F.col("zh"), F.lit("（"), F.col("canonical"), F.lit("）"))
    mixed = F.when(F.col("first_mention") & (term_key(F.col("zh")) != term_key(F.col("canonical"))), both).when(F.col("short_name") != "", F.col("short_name")).otherwise(F.col("zh"))
    target = F.when(F.col("policy") == "translate", F.col("zh")).when(F.col("policy") == "mixed", mixed).otherwise(F.col("canonical"))
    return met.select("video_id", "id", "term_id", "policy", "first_mention", target.alias("target"))


def translation_rules(glossary: DataFrame) -> DataFrame:
    """``form, replacement``: every spelling of terms to be translated, with the Chinese form; a key's first spelling."""
    rows = glossary.where((F.trim("policy") == "translate") & (F.trim("zh") != ""))
    forms = F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("bad_aliases", F.array().cast("array<string>")))
    spelled = rows.select(F.trim("zh").alias("replacement"), F.explode(F.transform(forms, lambda f: R.squash(f))).alias("form")).where("length(form) >= 2 AND form <> replacement")
    return spelled.groupBy(F.lower("form").alias("_k"), "replacement").agg(F.min("form").alias("form")).select("form", "replacement")


def translate_left_terms(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """``video_id, id, before, after, n_rules``: targets in which terms to be translated were left in English, put right."""
    return corrected(segments, translation_rules(glossary), ["video_id", "id"], "target_text")


def repair_rules(glossary: DataFrame) -> DataFrame:
    """``form, replacement``: bad spellings of three letters or more that aren't the term itself."""
    rows = glossary.where(F.length(R.squash(F.col("canonical"))) >= 3)
    spelled = rows.select(R.squash(F.col("canonical")).alias("replacement"), F.explode(F.transform("bad_aliases", lambda f: R.squash(f))).alias("form"))
    return spelled.where((F.length("form") >= 3) & (F.lower("form") != F.lower("replacement"))).distinct()


def repair_sources(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """``video_id, id, before, after, n_rules, words``: sources with bad spellings put right, and their timed words.

    Where the repaired text has as many words as are timed, each timed word takes its word; else those that still stand in it keep their times and the others go.
    """
    fixed = corrected(segments, repair_rules(glossary), ["video_id", "id"], "source_text")
    hit = fixed.join(segments.select("video_id", "id", "words"), ["video_id", "id"])
    told, wanted = F.split("after", " "), F.transform("words", lambda w: R.squash(w["word"]))
    renamed = F.transform("words", lambda w, k: F.struct(F.try_element_at(told, k + 1).alias("word"), w["start_s"].alias("start_s"), w["end_s"].alias("end_s"), w["confidence"].alias("confidence")))
    kept = F.filter("words", lambda w: F.array_contains(told, R.squash(w["word"])))
    return hit.select("video_id", "id", "before", "after", "n_rules", F.when(F.size(told) == F.size(wanted), renamed).otherwise(kept).alias("words"))


def preserved_only(texts: DataFrame, glossary: DataFrame, key: list[str], text: str) -> DataFrame:
    """``*key, canonical``: texts that are just a preserved term, as the glossary spells it. An equi-join on the term's key."""
    kept = glossary.where(F.trim("policy") == "preserve").select(term_key(F.col("canonical")).alias("_k"), F.trim("canonical").alias("canonical")).where("_k <> ''")
    kept = kept.groupBy("_k").agg(F.min("canonical").alias("canonical"))
    return texts.withColumn("_k", term_key(F.col(text))).join(kept, "_k").select(*key, "canonical")
