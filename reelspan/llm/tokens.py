"""Sizes of texts in tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are tokens alone, and blanks.
CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}"
_BLANK = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"


def token_count(text: Column) -> Column:
    """Tokens of a text without a vocabulary file: each CJK or kana character, each run of other letters
    and digits, each other character that isn't blank. Null has none. One pass of one pattern, JVM-side."""
    token = rf"[{CJK}]|[\p{{L}}\p{{N}}&&[^{CJK}]]+|[^{_BLANK}\p{{L}}\p{{N}}]"
    return F.coalesce(F.regexp_count(text, F.lit(token)), F.lit(0)).cast("bigint")


def token_count_sql(text: str) -> str:
    """The same for DuckDB."""
    bare = f"regexp_replace({text}, '[{CJK}]', ' ', 'g')"
    return (
        f"(coalesce(length({text}) - length(regexp_replace({text}, '[{CJK}]', '', 'g')) + len(regexp_extract_all({bare}, '[\\pL\\pN]+'))"
        f" + length(regexp_replace({bare}, '[\\s\\pZ\\x{{1c}}-\\x{{1f}}\\x{{85}}\\pL\\pN]', '', 'g')), 0))"
    )
