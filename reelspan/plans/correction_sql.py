"""SQL of corrections by rules."""

from __future__ import annotations

_FIX = lambda rules, text: f"list_reduce(list_prepend({text}, rules), lambda acc, x: regexp_replace(acc, string_split(x, chr(1))[1], string_split(x, chr(1))[2], 'g'))"


def corrected_sql(rows: str, rules: str, key: str, text: str, *, lead: str = "") -> str:
    """Texts with all rules (``w``: form, replacement) that match applied, longer forms first."""
    return f"""{lead}{rules}, e AS (SELECT DISTINCT form, '(?i)\\b' || regexp_replace(form, '([.^$*+?()\\[\\]{{}}|\\\\-])', '\\\\\\1', 'g') || '\\b' AS pattern, replacement FROM w),
h AS (SELECT {key}, any_value({text}) AS text, list(pattern || chr(1) || replacement ORDER BY length(form) DESC, form, replacement) AS rules FROM {rows} JOIN e ON regexp_matches({text}, pattern) GROUP BY {key})
SELECT {key}, after FROM (SELECT *, {_FIX('rules', 'text')} AS after FROM h) WHERE after <> text"""
