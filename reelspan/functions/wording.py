"""Measures, keys and fix-ups of wording as column expressions: what a text is like, how it is named, what of it is compared."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspan.functions import rules as R

# English words that make a short text translatable, and words after which a source is still open.
TRANSLATABLE_WORDS = (
    "am", "and", "are", "been", "being", "but", "can", "could", "did", "does", "had", "has", "have", "im", "is", "might", "must", "should", "that", "thats", "then", "these", "they", "this", "those", "was", "were",
    "will", "would", "you",
)
OPEN_TAIL_WORDS = (
    "a", "am", "an", "and", "are", "as", "at", "be", "because", "been", "being", "but", "by", "called", "for", "from", "if", "in", "into", "is", "made", "named", "of", "on", "or", "that", "the", "to", "was", "were",
    "when", "while", "with",
)
# Words said on their own, words that may be, answers to questions.
STRONG_PARTICLES = ("ah", "all right", "alright", "hey", "hmm", "huh", "no", "nope", "oh", "ok", "okay", "uh", "um", "whoa", "wow", "yeah", "yep", "yes", "you know", "yup")
AMBIGUOUS_PARTICLES = ("fine", "please", "right", "sure", "thanks", "well")
QUESTION_RESPONSES = ("ok", "okay", "right", "sure")
# Open ends of a Chinese target that say its translation was cut between segments.
OPEN_ALLOCATION_ENDS = ("，", "、", "；", "和", "与", "但", "而", "因为", "所以", "在", "从", "对", "的")


def translatable(text: Column) -> Column:
    """Whether a text has something to translate: Cyrillic, a first person, a sentence of three words, a function word, or seven words."""
    t = F.coalesce(text, F.lit(""))
    words = F.transform(F.regexp_extract_all(t, F.lit("([A-Za-z]{2,})"), 1), F.lower)
    function_word = F.arrays_overlap(words, F.array(*[F.lit(w) for w in TRANSLATABLE_WORDS]))
    several = (F.size(words) >= 2) & ((t.rlike("[.!?]") & (F.size(words) >= 3)) | (F.size(words) >= 7))
    return t.rlike(r"[\x{0400}-\x{052f}]") | t.rlike(r"(^|[^A-Za-z])[iI](?![A-Za-z0-9_])") | several | function_word


def term_key(text: Column) -> Column:
    """Letters and digits of a term, case aside; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def pure_term(text: Column) -> Column:
    """A term's key without a leading article and a possessive."""
    t = F.regexp_replace(R.squash(text), r"^[\p{P}\p{S} ]+|[\p{P}\p{S} ]+$", "")
    return term_key(F.regexp_replace(F.regexp_replace(t, r"(?i)^(the|a|an) +", ""), "(?i)('s|s')$", ""))


@F.pandas_udf(T.StringType())
def compatible_key(text: pd.Series) -> pd.Series:
    """Compatibility form, case folded: no built-in function has it. Null is empty."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t).casefold() if isinstance(t, str) else "")


def first_person(text: Column) -> Column:
    """A lone i as I."""
    return F.regexp_replace(text, r"(?<![A-Za-z0-9_])i(?![A-Za-z0-9_])", "I")


def language_code(lang: Column) -> Column:
    """ru, en or zh for what starts so, English for none, else as it is, lower-cased."""
    t = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
    return F.when(F.left(t, F.lit(2)).isin("ru", "en", "zh"), F.left(t, F.lit(2))).when(t == "", "en").otherwise(t)


def sentence_count(text: Column) -> Column:
    """Sentences of a source; titles and e.g. don't end one."""
    t = R.squash(text)
    guarded = F.regexp_replace(t, r"\b(Mr|Dr|Ms|Mrs|e\.g|i\.e)\.", "$1")
    return F.size(F.filter(F.split(guarded, "[.!?] +"), lambda p: F.trim(p) != ""))


def meaning_chunks(text: Column) -> Column:
    """Pieces of a text, each with the mark that ends it; a full stop inside a number or name and a drive's colon end none."""
    t = R.squash(text)
    marked = F.regexp_replace(F.regexp_replace(t, r"(?<=[\p{L}\p{N}])\.(?=[\p{L}\p{N}])", "\u0001"), r"(?<=\p{L}):(?=[\\/])", "\u0002")
    cut = F.filter(F.transform(F.split(F.regexp_replace(marked, r"([，,、；;：:。.!！？?]) ?", "$1\u0003"), "\u0003"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(cut, lambda p: F.replace(F.replace(p, F.lit("\u0001"), F.lit(".")), F.lit("\u0002"), F.lit(":")))


def mixed_tokens(text: Column) -> Column:
    """Latin words, paths and names whole, blanks, and each other sign."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z0-9][A-Za-z0-9_./:\\+~#@%&=-]*|[.][A-Za-z0-9_./:\\+~#@%&=-]+|\s+|.)"), 1)


def tail_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9']+)"), 1), F.lower)


def short_tail(left: Column, right: Column, gap_ms: Column, *, apart_ms: int = 180) -> Column:
    """What a cue of one or two words with a full stop is to the one before it: content_tail, standalone_particle, ambiguous_particle or not_terminal_short."""
    r, before = F.trim(F.coalesce(right, F.lit(""))), tail_words(left)
    words = tail_words(right)
    phrase, first = F.array_join(words, " "), F.try_element_at(words, F.lit(1))
    ends = lambda t: F.trim(F.coalesce(t, F.lit(""))).rlike(r"[.!?][\"')\]]*$")
    is_short = (r != "") & (F.size(words) <= 2) & ends(right)
    open_left = (F.size(before) > 0) & (~ends(left) | F.try_element_at(before, F.lit(-1)).isin(*OPEN_TAIL_WORDS))
    return (
        F.when(~is_short, "not_terminal_short").when(open_left, "content_tail")
        .when(phrase.isin(*STRONG_PARTICLES), F.when(gap_ms.isNull() | (gap_ms >= apart_ms), "standalone_particle").otherwise("ambiguous_particle"))
        .when(F.trim(F.coalesce(left, F.lit(""))).endswith("?") & first.isin(*QUESTION_RESPONSES), "standalone_particle")
        .when(phrase.isin(*AMBIGUOUS_PARTICLES), "ambiguous_particle").when(F.substring(r, 1, 1).rlike(r"\p{Ll}"), "content_tail").otherwise("not_terminal_short")
    )


def clean_title(title: Column) -> Column:
    """A title without what stands in brackets, part numbers, fractions and signs."""
    t = F.regexp_replace(F.coalesce(title, F.lit("")), r"[\[(（【].*?[\])）】]", " ")
    t = F.regexp_replace(t, r"(?i)\b(ep|episode|part|pt|p) *[.#:-]? *[0-9]+\b", " ")
    t = F.regexp_replace(t, r"\b[0-9]+ */ *[0-9]+\b", " ")
    return R.squash(F.regexp_replace(t, r"[^\p{L}\p{N}_\s'-]+", " "))


def proper_phrases(title: Column, *, most: int = 5) -> Column:
    """Different runs of up to four capitalised words, case aside, the first ``most``."""
    found = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"\b([A-Z][A-Za-z0-9'-]+(?:\s+[A-Z][A-Za-z0-9'-]+){0,3})"), 1)
    keep = F.filter(found, lambda p: F.lower(p) != "youtube")
    lower = F.transform(keep, F.lower)
    return F.slice(F.filter(keep, lambda p, k: F.array_position(lower, F.lower(p)) == k + 1), 1, most)


def strip_markup(text: Column) -> Column:
    """A page's text without scripts, styles and tags, the common character references put in."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]+>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return R.squash(t)


def video_key(url: Column) -> Column:
    """A video's id in its address, empty if there is none."""
    return F.coalesce(*[F.when(F.regexp_extract(url, p, 1) != "", F.regexp_extract(url, p, 1)) for p in (r"[?&]v=([A-Za-z0-9_-]{6,})", r"youtu\.be/([A-Za-z0-9_-]{6,})", r"youtube\.com/shorts/([A-Za-z0-9_-]{6,})")], F.lit(""))


def slug(text: Column, *, most: int = 80) -> Column:
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9._-]+", "-")
    return F.left(F.regexp_replace(t, "^[-._]+|[-._]+$", ""), F.lit(most))


def artifact_kind(name: Column) -> Column:
    """What a file is, by its name."""
    n = F.lower(name)
    has = lambda *parts: F.contains(n, F.lit(parts[0])) & (F.contains(n, F.lit(parts[1])) if len(parts) > 1 else F.lit(True))
    return (
        F.when(n.endswith(".mp4"), "video").when(n.endswith(".ass"), "ass").when(has("qa"), "qa").when(has("entity", "metric"), "entity_metrics").when(has("entity", "review"), "entity_review")
        .when(has("manifest"), "manifest").when(has("translated_segments"), "segments").otherwise("artifact")
    )


def clamp(value: Column, least: float, most: float, otherwise: float) -> Column:
    """A number kept within bounds; ``otherwise`` for none."""
    v = value.try_cast("double")
    return F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), F.when(v.isNull() | F.isnan(v), F.lit(float(otherwise))).otherwise(v)))


def ratio(part: Column, whole: Column) -> Column:
    """A share, 0 of nothing."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def hex_color(value: Column, otherwise: str = "#FFFFFF") -> Column:
    """``#RRGGBB`` of a colour with three or six digits."""
    raw = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "^#", "")
    raw = F.when(raw.rlike("^[0-9a-fA-F]{3}$"), F.regexp_replace(raw, "(.)", "$1$1")).otherwise(raw)
    return F.upper(F.when(raw.rlike("^[0-9a-fA-F]{6}$"), F.concat(F.lit("#"), raw)).otherwise(F.lit(otherwise)))


def ass_color(value: Column, opacity: Column, otherwise: str = "#FFFFFF") -> Column:
    """``&HAABBGGRR`` of a colour and its opacity in percent."""
    c = hex_color(value, otherwise)
    alpha = F.bround(255 * (100 - F.bround(clamp(opacity, 0, 100, 100))) / 100).cast("int")
    return F.concat(F.lit("&H"), F.lpad(F.hex(alpha), 2, "0"), F.substring(c, 6, 2), F.substring(c, 4, 2), F.substring(c, 2, 2))


def fenced_json(text: Column, schema: str) -> Column:
    """A model's answer as rows of a schema, a fence of backticks around it taken off; null where it is none."""
    return F.from_json(F.regexp_replace(F.trim(text), r"(?s)^```[a-zA-Z]*\s*|\s*```$", ""), schema)
