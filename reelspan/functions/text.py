"""Column expressions on text that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks and line breaks of any script, in a form that both Java and RE2 read alike.
BLANK = r"[\s\p{Z}]"


def fold(text: Column) -> Column:
    """Outer blanks removed, each inner run of blanks and line breaks made one space; null stays null."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def name_key(text: Column) -> Column:
    """Folded and lower-cased, for values that are compared without regard to case and blanks."""
    return F.lower(fold(text))


def millis(seconds: Column) -> Column:
    """Whole milliseconds of a time in seconds; null for null, NaN and infinite."""
    usable = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(9e15))
    return F.when(usable, F.round(seconds * 1000).cast("bigint"))
