"""Dictionary terms in texts: matches, consistency, corrections, frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions import rules as R


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _grams(words: Column, n: Column) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")))


def term_hits(texts: DataFrame, terms: DataFrame, key: list[str], text: str, term: str) -> DataFrame:
    """``*key, *columns of terms`` for each text that contains a term between characters that are no Latin letters or digits, case aside.

    Terms are joined on their words: texts are spelled out in runs of as many words as terms have, so a dictionary of any size is an
    equi-join and not a product; the boundaries and separators are checked on the candidates. How long terms are is one small aggregate.
    Cases: null or wordless texts and terms match nothing; a repeated term matches as often; terms of signs without Latin words don't match here.
    """
    rows = terms.where(F.size(_words(F.col(term))) > 0).withColumn("_n", F.size(_words(F.col(term)))).withColumn("_gram", F.array_join(_words(F.col(term)), " "))
    lengths = [r[0] for r in rows.select("_n").distinct().orderBy("_n").collect()]
    if not lengths:
        lengths = [1]
    words = texts.select(*key, F.col(text).alias("_text"), _words(F.col(text)).alias("_w"))
    grams = F.array_distinct(F.flatten(F.array_compact(F.array(*[_grams(F.col("_w"), F.lit(n)) for n in lengths]))))
    spelled = words.select(*key, "_text", F.explode(grams).alias("_gram"))
    return spelled.join(rows, "_gram").where(R.contains_term(F.col("_text"), F.col(term))).select(*key, *terms.columns).distinct()


def consistency(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """``video_id, id, term_id, issue``: bad_alias_source, bad_alias_target, term_not_preserved, term_not_translated.

    A kept term must stand in the target if it stands in the source; a translated one must not be left if its Chinese form is missing.
    Segments with an empty target have no issue of the last two kinds.
    """
    wide = glossary.where(F.length(F.trim("canonical")) >= 3)
    bad = wide.select("term_id", F.explode("bad_aliases").alias("form")).where(F.length(F.trim("form")) >= 3)
    key = ["video_id", "id"]
    in_source = term_hits(segments, bad, key, "source_text", "form").select(*key, "term_id", F.lit("bad_alias_source").alias("issue"))
    in_target = term_hits(segments, bad, key, "target_text", "form").select(*key, "term_id", F.lit("bad_alias_target").alias("issue"))
    terms = wide.select("term_id", "canonical", "policy", "zh")
    named = term_hits(segments, terms, key, "source_text", "canonical").join(segments.select(*key, "target_text"), key).where(F.trim("target_text") != "")
    kept = R.contains_term(F.col("target_text"), F.col("canonical"))
    lost = named.where((F.col("policy") == "preserve") & ~kept).select(*key, "term_id", F.lit("term_not_preserved").alias("issue"))
    left = named.where((F.col("policy") != "preserve") & (F.col("zh") != F.col("canonical")) & kept & ~F.contains("target_text", F.regexp_replace("zh", "[《》]", ""))).select(*key, "term_id", F.lit("term_not_translated").alias("issue"))
    return in_source.unionByName(in_target).unionByName(lost).unionByName(left).distinct()


def corrected(texts: DataFrame, rules: DataFrame, key: list[str], text: str) -> DataFrame:
    """``*key, before, after, n_rules`` of texts that a rule (``form``, ``replacement``) changes; longer forms go first.

    Only texts with a match are rewritten, by a fold over their own rules inside one expression.
    """
    hits = term_hits(texts, rules.select("form", "replacement").where("form IS NOT NULL AND replacement IS NOT NULL"), key, text, "form")
    escaped = F.regexp_replace("form", r"([.^$*+?()\[\]{}|\\-])", r"\\$1")
    own = hits.withColumn("_p", F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), escaped, F.lit("(?![A-Za-z0-9])"))).withColumn("_r", F.regexp_replace("replacement", r"([\\$])", r"\\$1"))
    own = own.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct((-F.length("form")).alias("_o"), "form", "replacement", "_p", "_r"))).alias("_rules"))
    out = texts.select(*key, F.col(text).alias("before")).join(own, key)
    out = out.withColumn("after", F.aggregate("_rules", F.col("before"), lambda acc, r: F.regexp_replace(acc, r["_p"], r["_r"])))
    return out.where("before <> after").select(*key, "before", "after", F.size("_rules").alias("n_rules"))


def phrase_counts(texts: DataFrame, text: str, *, at_least: int = 2) -> DataFrame:
    """Capitalised phrases of two or three words, how often and with which confidence: ``phrase, n, confidence_pct`` (45 and 5 for each, 82 at most)."""
    phrases = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+){1,2})"), 1)).alias("phrase"))
    counts = phrases.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    return counts.withColumn("confidence_pct", F.least(F.lit(82), 45 + 5 * F.col("n")))


def near_forms(terms: DataFrame, term_id: str, name: str, *, most: int = 2) -> DataFrame:
    """Pairs of two-word terms that differ in one word by at most ``most`` letters: ``id_a, id_b``, lesser first.

    Blocked on the word they share and its place, so terms without a common word never meet.
    """
    words = terms.select(F.col(term_id).alias("id"), F.split(F.lower(F.col(name)), " ").alias("w")).where(F.size("w") == 2)
    sides = words.select("id", F.lit(0).alias("place"), F.col("w")[0].alias("same"), F.col("w")[1].alias("other")).unionByName(words.select("id", F.lit(1).alias("place"), F.col("w")[1].alias("same"), F.col("w")[0].alias("other")))
    a, b = sides.alias("a"), sides.alias("b")
    met = a.join(b, (F.col("a.place") == F.col("b.place")) & (F.col("a.same") == F.col("b.same")) & (F.col("a.id") < F.col("b.id")))
    return met.where(F.levenshtein("a.other", "b.other") <= most).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
