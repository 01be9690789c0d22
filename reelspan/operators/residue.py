"""Latin residue in Chinese targets, unwanted scripts, and phrases said twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions import rules as R

# Score from which a residue may stay, from how it is known.
BASE_SCORES = {"explicit_preserve": 100, "code_or_identifier": 94, "abbreviation": 78, "glossary_soft_preserve": 62, "proper_name": 55, "single_title_word": 35, "known_translate_entity": 25, "function_or_discourse": 0, "ordinary_english": 15}
PRESERVE, REVIEW = 85, 70
# Scripts that a Chinese or source text should not hold, as first and last code points.
UNWANTED_SCRIPTS = {
    "Greek": (0x0370, 0x03FF), "Cyrillic": (0x0400, 0x052F), "Hebrew": (0x0590, 0x05FF), "Arabic": (0x0600, 0x06FF), "Syriac": (0x0700, 0x074F), "Thaana": (0x0780, 0x07BF), "Devanagari": (0x0900, 0x097F),
    "Bengali": (0x0980, 0x09FF), "Gurmukhi": (0x0A00, 0x0A7F), "Gujarati": (0x0A80, 0x0AFF), "Oriya": (0x0B00, 0x0B7F), "Tamil": (0x0B80, 0x0BFF), "Telugu": (0x0C00, 0x0C7F), "Kannada": (0x0C80, 0x0CFF),
    "Malayalam": (0x0D00, 0x0D7F), "Thai": (0x0E00, 0x0E7F), "Lao": (0x0E80, 0x0EFF), "Hangul Jamo": (0x1100, 0x11FF), "Hangul": (0xAC00, 0xD7AF),
}

CANDIDATE = r"[A-Za-z][A-Za-z0-9_+./\\'-]*(?: [A-Za-z][A-Za-z0-9_+./\\'-]*)*"


def term_key(text: Column) -> Column:
    """Case, blanks and outer punctuation aside."""
    return F.regexp_replace(R.squash(F.lower(text)), r"^[^a-z0-9]+|[^a-z0-9]+$", "")


def residue(segments: DataFrame, glossary: DataFrame, entities: DataFrame) -> DataFrame:
    """``video_id, id, candidate, category, score, decision``: runs of Latin words left in Chinese targets, and whether they may stay.

    A run is known by the glossary (kept if its policy is 'preserve', firmly if its priority is 'hard'; to be translated otherwise) or by an entity, else by its
    form: code, abbreviation, name, word. What isn't in the source scores 50 at most, a single plain word in a Chinese line 25 less; 85 stays,
    70 is looked at. Known keys are one equi-join, each row once; targets without CJK signs have no residue.
    """
    known = glossary.select(term_key(F.col("canonical")).alias("key"), F.when(F.col("policy") != "preserve", 3).when(F.lower("priority") == "hard", 1).otherwise(2).alias("k"))
    known = known.unionByName(entities.select(term_key(F.col("canonical_en")).alias("key"), F.lit(3).alias("k"))).where("key <> ''").groupBy("key").agg(F.max("k").alias("k"))
    rows = segments.where(R.has_chinese(F.col("target_text"))).select("video_id", "id", "source_text", F.explode(F.array_distinct(F.regexp_extract_all("target_text", F.lit(f"({CANDIDATE})"), 1))).alias("candidate"))
    rows = rows.withColumn("key", term_key(F.col("candidate"))).join(known, "key", "left")
    words = F.size(F.split("candidate", " "))
    category = (
        F.when(F.col("k") == 3, "known_translate_entity").when(F.col("k") == 1, "explicit_preserve").when(F.rlike("candidate", F.lit(r"[0-9_/\\]|[A-Za-z]\.[A-Za-z]|[a-z][A-Z]")), "code_or_identifier")
        .when(F.col("k") == 2, "glossary_soft_preserve").when((words == 1) & F.col("key").isin(*R.OPEN_END_WORDS, *R.CONTINUATION_WORDS, *R.LEFT_MARKERS), "function_or_discourse")
        .when((words == 1) & F.rlike("candidate", F.lit("^[A-Z][A-Z0-9.-]{1,8}$")), "abbreviation").when((words > 1) & ~F.rlike("candidate", F.lit("(^| )[^A-Z]")), "proper_name")
        .when((words == 1) & F.rlike("candidate", F.lit("^[A-Z]")), "single_title_word").otherwise("ordinary_english")
    )
    rows = rows.withColumn("category", category)
    base = F.coalesce(*[F.when(F.col("category") == c, F.lit(v)) for c, v in BASE_SCORES.items()])
    firm = F.col("category").isin("explicit_preserve", "code_or_identifier")
    score = F.greatest(F.lit(0), base - F.when((words == 1) & ~firm, 25).otherwise(0))
    absent = ~F.coalesce(F.contains(F.lower("source_text"), F.lower("candidate")), F.lit(False))
    score = F.when(absent & (F.col("category") != "explicit_preserve"), F.least(score, F.lit(50))).otherwise(score)
    rows = rows.withColumn("score", score.cast("int"))
    return rows.select("video_id", "id", "candidate", "category", "score", F.when(F.col("score") >= PRESERVE, "preserve").when(F.col("score") >= REVIEW, "review").otherwise("translate").alias("decision"))


def unwanted_scripts(text: Column) -> Column:
    """Names of unwanted scripts and of broken encoding in a text, in fixed order; null has none."""
    found = [F.when(text.rlike(rf"[\x{{{a:04x}}}-\x{{{b:04x}}}]"), F.lit(name)) for name, (a, b) in UNWANTED_SCRIPTS.items()]
    return F.array_compact(F.array(F.when(text.rlike(r"\x{fffd}|锟斤拷|â€"), F.lit("broken encoding")), *found))


def repeated_phrases(text: Column) -> Column:
    """Sentences of two to six words that a text says more than once, lower-cased, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?;,。！？；，]+"), lambda p: F.trim(F.regexp_replace(F.lower(p), r"[^\p{L}\p{N}]+", " ")))
    sized = F.filter(parts, lambda p: (p != "") & F.size(F.split(p, " ")).between(2, 6))
    return F.array_sort(F.array_distinct(F.filter(sized, lambda p: F.size(F.filter(sized, lambda q: q == p)) > 1)))


def merge_terms(terms: DataFrame) -> DataFrame:
    """One row a key of terms from several sources (``canonical, zh, confidence, aliases, rank``): the spelling and Chinese form of the best rank, the
    highest confidence, all other spellings and the number of sources. Blank keys don't count."""
    rows = terms.withColumn("key", term_key(F.col("canonical"))).where("key <> ''")
    first = lambda c: F.min_by(F.col(c), F.struct("rank", "canonical"))
    zh = F.min(F.when(F.trim("zh") != "", F.struct("rank", "canonical", "zh")))["zh"]
    return rows.groupBy("key").agg(
        first("canonical").alias("canonical"), zh.alias("zh"), F.max("confidence").alias("confidence"), F.countDistinct("rank").alias("n_sources"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: R.squash(a)))))), "|").alias("aliases"),
    )
