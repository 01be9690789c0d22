"""Predicates and measures of subtitle text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspan.functions.text import BLANK

# Function words at the edges of source fragments, open ends of Chinese targets.
OPEN_END_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "his", "in", "into", "of", "on", "the", "to", "with")
CONTINUATION_WORDS = ("and", "as", "because", "but", "for", "from", "how", "i", "if", "of", "or", "that", "then", "to", "when", "which", "while", "who", "with")
OPEN_TARGET_ENDS = ("，", "、", "；", "和", "与", "及", "并", "而", "但", "被", "把", "在", "从", "对", "向", "为", "由", "是", "以", "的")
# English words that a Chinese target should not keep, scripts it should not hold (first and last code points), signs of broken encoding.
LEFT_MARKERS = (
    "actually", "again", "alright", "and", "anyway", "basically", "because", "but", "cause", "exactly", "honestly", "i", "i'd", "i'll", "i'm", "i've", "im", "just", "like", "literally", "maybe",
    "okay", "ok", "right", "see", "seriously", "so", "sure", "that's", "thats", "there's", "theres", "then", "though", "well", "yeah", "yep", "yes", r"there\s+(?:is|are|was|were)",
)
TARGET_SCRIPTS = (
    (0x0370, 0x052F), (0x0590, 0x074F), (0x0780, 0x07BF), (0x0900, 0x0AFF), (0x0B00, 0x0D7F), (0x0E00, 0x0EFF), (0x1100, 0x11FF), (0xAC00, 0xD7AF),
)
BROKEN = "\ufffd|锟斤拷|â€[™œ“”¦–—]|ï¼|ã€|[銆锛鏄]|鐨勬|涓嶅|浠栧|杩欐"
BROKEN_HINTS = "鐨浠涓鍦鏄杩瀹緇絜嬪勬堕戣"

CJK = r"[\x{3400}-\x{9fff}]"
TERMINAL = r"[.!?。！？][\"')\]]*$"
WORD = r"[A-Za-z][A-Za-z0-9'.-]*"


def squash(text: Column) -> Column:
    """Blanks of any script folded and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{BLANK}+", " "))


def visible_length(text: Column) -> Column:
    """Characters that aren't blank; null has none."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"{BLANK}+", ""))


def has_chinese(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


def ends_sentence(text: Column) -> Column:
    return squash(text).rlike(TERMINAL)


def first_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(squash(text), rf"^[^A-Za-z]*({WORD})", 1))


def last_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(squash(text), rf"({WORD})[^A-Za-z]*$", 1))


def opens_with_continuation(text: Column) -> Column:
    return F.regexp_replace(first_word(text), r"[.']+$", "").isin(*CONTINUATION_WORDS)


def ends_with_open_word(text: Column) -> Column:
    return F.regexp_replace(last_word(text), r"[.']+$", "").isin(*OPEN_END_WORDS)


def ends_with_open_target(text: Column) -> Column:
    return squash(text).rlike("(" + "|".join(OPEN_TARGET_ENDS) + ")$")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+(?:[.,]\d+)?)"), 1)


def characters_per_second(text: Column, start_ms: Column, end_ms: Column) -> Column:
    return visible_length(text) / (F.greatest(end_ms - start_ms, F.lit(1)) / 1000)


def severity(value: Column, soft: float, hard: float) -> Column:
    """'hard' over the hard limit, 'soft' over the soft one, else null."""
    return F.when(value > hard, "hard").when(value > soft, "soft")


def polluted(text: Column) -> Column:
    """Whether a Chinese text holds an unwanted script or signs of broken encoding, four different hints of it at least."""
    scripts = "".join(rf"\x{{{a:04x}}}-\x{{{b:04x}}}" for a, b in TARGET_SCRIPTS)
    hints = F.array_distinct(F.regexp_extract_all(text, F.lit(f"([{BROKEN_HINTS}])"), 1))
    return text.rlike(f"[{scripts}]|{BROKEN}") | (F.size(hints) >= 4)


def leaves_marker(text: Column) -> Column:
    """Whether a text with Chinese signs keeps an English marker."""
    plain = F.translate(text, "`’", "''")
    return has_chinese(text) & plain.rlike(rf"(?iu)(?<![A-Za-z0-9_.-])(?:{'|'.join(LEFT_MARKERS)})(?![A-Za-z0-9_-])")


def repeats_phrase(text: Column) -> Column:
    """Whether a sentence of two to six Latin words stands in a text twice, case and other signs aside."""
    words = lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"([A-Za-z][A-Za-z0-9'.-]*)"), 1), lambda w: F.regexp_replace(F.lower(w), "'+$", ""))
    said = F.filter(F.transform(F.split(text, "[.!?。！？]+"), words), lambda p: F.size(p).between(2, 6))
    return text.rlike("[.!?。！？].*[A-Za-z]") & (F.size(F.array_distinct(said)) < F.size(said))


def latin_share(text: Column) -> Column:
    """Latin letters among visible characters; 0 for empty text."""
    seen = visible_length(text)
    return F.when(seen > 0, F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z]", "")) / seen).otherwise(F.lit(0.0))


def contains_term(text: Column, term: Column) -> Column:
    """Whether a term stands in a text between characters that are no Latin letters or digits, case aside."""
    escaped = F.regexp_replace(F.lower(term), r"([.^$*+?()\[\]{}|\\-])", r"\\$1")
    return F.rlike(F.lower(text), F.concat(F.lit("(^|[^a-z0-9])"), escaped, F.lit("([^a-z0-9]|$)")))


def ass_time(ms: Column) -> Column:
    """``h:mm:ss.cc`` of milliseconds, hundredths rounded half up, negative as zero."""
    cs = F.floor((F.greatest(ms, F.lit(0)) + 5) / 10)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def srt_time(ms: Column) -> Column:
    """``hh:mm:ss,mmm`` of milliseconds, negative as zero."""
    t = F.greatest(ms, F.lit(0)).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3600000), F.floor(t / 60000) % 60, F.floor(t / 1000) % 60, t % 1000)


def parse_clock(text: Column) -> Column:
    """Milliseconds of ``h:mm:ss.cc``, ``hh:mm:ss,mmm``, ``mm:ss`` or plain seconds; null for anything else."""
    t = F.regexp_replace(F.trim(text), ",", ".")
    parts = F.split(t, ":")
    ok = t.rlike(r"^\d+(:\d{1,2}){0,2}(\.\d+)?$")
    seconds = F.aggregate(F.transform(parts, lambda p: p.try_cast("double")), F.lit(0.0), lambda acc, p: acc * 60 + p)
    return F.when(ok, F.round(seconds * 1000).cast("bigint"))


def multiset_similarity(a: Column, b: Column) -> Column:
    """Shared characters of two texts, with repetition, by those of the longer; blanks don't count. Both empty are alike, one empty is not.

    Each distinct character of the first is counted on both sides by length differences, inside one expression.
    """
    x, y = (F.regexp_replace(F.coalesce(c, F.lit("")), f"{BLANK}+", "") for c in (a, b))
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.filter(F.split(x, ""), lambda c: c != "")), F.lit(0), lambda acc, c: acc + F.least(count(x, c), count(y, c)))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(shared / longest)


def text_shape(text: Column) -> Column:
    """A text's shape: runs of CJK signs ZH, Latin words EN, numbers NUM, punctuation as it is."""
    t = F.regexp_replace(squash(text), CJK + "+", "\u0001")
    t = F.regexp_replace(t, r"[A-Za-z][A-Za-z'-]*", "EN")
    t = F.regexp_replace(t, r"[0-9]+(?:[.,][0-9]+)*", "NUM")
    return F.regexp_replace(t, "\u0001", "ZH")
