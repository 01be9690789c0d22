"""Lines and parts of texts: wrapping of Chinese, even division into parts, cuts of Latin and Cyrillic texts at least cost.

Order-dependent choices over a text's own tokens, in Arrow batches; each text is looked at alone and whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKENS = re.compile(r"[A-Za-z0-9][A-Za-z0-9_./:\\+~#@%&=-]*|[.][A-Za-z0-9_./:\\+~#@%&=-]+|\s+|.")
_ENDS = "。！？!?"
_PAUSES = "，、；：,;:"
# Signs no line may start with.
_NO_START = "，。、；：！？）》」』”’,.;:!?)"
_LOOSE = frozenset("a an and as at but by for from if in into of on or that the to with и а но в во на с со к у о об от до по за из для что".split())


def _visible(tokens: Sequence[str]) -> int:
    return sum(len(t) for t in tokens if not t.isspace())


def _cut(tokens: Sequence[str], parts: int, cost: Callable[[Sequence[str], Sequence[str]], float]) -> list[str]:
    """Tokens in so many parts of even length, each cut shifted to where it costs least nearby."""
    if parts <= 1 or len(tokens) < 2:
        return ["".join(tokens).strip()]
    size = [0]
    for t in tokens:
        size.append(size[-1] + (0 if t.isspace() else len(t)))
    whole, cuts, last = size[-1], [], 0
    for k in range(1, parts):
        ideal, left = whole * k / parts, parts - k
        places = range(last + 1, len(tokens) - left + 1)
        if not places:
            break
        best = min(places, key=lambda p: (abs(size[p] - ideal) / max(1.0, whole / parts) * 10 + cost(tokens[:p], tokens[p:]), p))
        cuts.append(best)
        last = best
    edges = [0, *cuts, len(tokens)]
    return [s for a, b in zip(edges, edges[1:], strict=False) if (s := "".join(tokens[a:b]).strip())]


def _chinese_cost(before: Sequence[str], after: Sequence[str]) -> float:
    last = next((t for t in reversed(before) if not t.isspace()), "")
    first = next((t for t in after if not t.isspace()), "")
    if first and first[0] in _NO_START:
        return 1000.0
    return 0.0 if last[-1:] in _ENDS else 1.0 if last[-1:] in _PAUSES else 5.0 if last and first and last[-1].isascii() != first[0].isascii() else 6.0


def _word_cost(before: Sequence[str], after: Sequence[str]) -> float:
    if not (before[-1].isspace() or after[0].isspace()):
        return 1000.0
    last = next((t for t in reversed(before) if not t.isspace()), "")
    return 0.0 if last[-1:] in ".!?…" else 2.0 if last[-1:] in ",;:—" else 9.0 if last.lower().strip("\"'(") in _LOOSE else 5.0


def chinese_parts(text: str | None, parts: int) -> list[str]:
    """A Chinese text in up to so many parts of even length, at marks where there are any; Latin words stay whole. None is no part."""
    return _cut(_TOKENS.findall(re.sub(r"\s+", " ", text.strip())), parts, _chinese_cost) if text and text.strip() else []


def wrap_chinese_text(text: str | None, max_chars: int = 28, max_lines: int = 2, trigger: int | None = None) -> str:
    """A Chinese text in lines of up to ``max_chars`` where ``max_lines`` allow that, even ones else; one line up to ``trigger`` signs."""
    if not text or not text.strip():
        return ""
    tokens = _TOKENS.findall(re.sub(r"\s+", " ", text.strip()))
    n = _visible(tokens)
    if n <= (trigger or max_chars):
        return "".join(tokens)
    for lines in range(2, max_lines + 1):
        made = _cut(tokens, lines, _chinese_cost)
        if all(len(re.sub(r"\s+", "", x)) <= max_chars for x in made) or lines == max_lines:
            return "\n".join(made)
    return "".join(tokens)


def word_parts(text: str | None, max_chars: int, max_parts: int) -> list[str]:
    """A Latin or Cyrillic text in as few parts as fit ``max_chars``, ``max_parts`` at most, cut between words where it costs least: after sentences, then clauses, never after a loose word if another place is near."""
    if not text or not text.strip():
        return []
    tokens = re.findall(r"\s+|\S+", re.sub(r"\s+", " ", text.strip()))
    made = ["".join(tokens)]
    for parts in range(1, max_parts + 1):
        made = _cut(tokens, parts, _word_cost)
        if all(len(p) <= max_chars for p in made):
            break
    return made


@F.pandas_udf(T.StringType())
def _wrapped(text: pd.Series, chars: pd.Series, lines: pd.Series) -> pd.Series:
    return pd.Series([wrap_chinese_text(t if isinstance(t, str) else None, int(c), int(n)) for t, c, n in zip(text, chars, lines, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parted(text: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([chinese_parts(t if isinstance(t, str) else None, int(n)) for t, n in zip(text, parts, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _worded(text: pd.Series, chars: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([word_parts(t if isinstance(t, str) else None, int(c), int(n)) for t, c, n in zip(text, chars, parts, strict=True)])


def wrap_chinese(text: Column, max_chars: int = 28, max_lines: int = 2) -> Column:
    return _wrapped(text, F.lit(max_chars), F.lit(max_lines))


def split_chinese(text: Column, parts: Column) -> Column:
    return _parted(text, parts)


def split_words(text: Column, max_chars: int, max_parts: int) -> Column:
    return _worded(text, F.lit(max_chars), F.lit(max_parts))
