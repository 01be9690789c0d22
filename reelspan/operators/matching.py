"""Set-oriented joins between the relations of a video: reconciliation, shared times, overrides, terms of descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(expected: DataFrame, given: DataFrame, key: list[str]) -> DataFrame:
    """``*key, status``: 'missing' for keys that were expected and not given, 'extra' for the reverse. One full join of distinct keys."""
    a, b = (df.select(*key).distinct().withColumn(mark, F.lit(True)) for df, mark in ((expected, "_a"), (given, "_b")))
    both = a.join(b, key, "full_outer")
    return both.where("_a IS NULL OR _b IS NULL").select(*key, F.when(F.col("_b").isNull(), "missing").otherwise("extra").alias("status"))


def lines_over_broken_lines(events: DataFrame) -> DataFrame:
    """Events of layer 0 shown at the very time of an event of layer 1 that has a line break: these need room. A semi-join, so no event comes twice."""
    broken = events.where((F.col("layer") == 1) & F.contains("text", F.lit("\\N"))).select("video_id", "start_ms", "end_ms")
    return events.where("layer = 0").join(broken, ["video_id", "start_ms", "end_ms"], "left_semi")


def overridden(base: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have a key, each column of ``overrides`` that isn't null holds."""
    rest = [c for c in base.columns if c != key]
    b, o = base.alias("b"), overrides.alias("o")
    joined = b.join(o, F.col(f"b.{key}") == F.col(f"o.{key}"), "full_outer")
    return joined.select(F.coalesce(f"o.{key}", f"b.{key}").alias(key), *[F.coalesce(f"o.{c}", f"b.{c}").alias(c) if c in overrides.columns else F.col(f"b.{c}").alias(c) for c in rest])


def description_terms(text: Column) -> Column:
    """Tags, mentions and hosts that a description names, lower-cased and distinct, as ``kind:value``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    tags = F.transform(F.regexp_extract_all(low, F.lit(r"#([a-z0-9_]+)"), 1), lambda x: F.concat(F.lit("tag:"), x))
    mentions = F.transform(F.regexp_extract_all(low, F.lit(r"@([a-z0-9_]+)"), 1), lambda x: F.concat(F.lit("mention:"), x))
    hosts = F.transform(F.regexp_extract_all(low, F.lit(r"https?://([a-z0-9.-]+)"), 1), lambda x: F.concat(F.lit("host:"), x))
    return F.array_distinct(F.concat(tags, mentions, hosts))
