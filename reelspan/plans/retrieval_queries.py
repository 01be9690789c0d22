"""Queries on duplicate candidates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.operators import retrieval as V
from reelspan.runtime import read


def duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five likeliest copies for every project whose number is divisible by 100."""
    meta = read(spark, sf_dir, "source_meta", "project_id", "title", "author", "published_at", "duration")
    meta = meta.groupBy("project_id").agg(F.min_by(F.struct("title", "author", "published_at", "duration"), F.struct("published_at", "title")).alias("x")).select(F.col("project_id").alias("id"), "x.*")
    return V.ranked_candidates(meta.where(F.regexp_extract("id", r"(\d+)", 1).try_cast("bigint") % 100 == 0), meta)


def candidate_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely the copies found are."""
    return V.score_histogram(duplicate_candidates(spark, sf_dir))


_GEN = ", ".join(f"'{w}'" for w in V.GENERIC)
_RANKED = rf"""
WITH u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY published_at, title) AS k FROM source_meta) WHERE k = 1),
d AS (SELECT project_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^\pL\pN]+'), lambda w: w <> '' AND w NOT IN ({_GEN}))) AS w, lower(trim(regexp_replace(author, '[\s\pZ]+', ' ', 'g'))) AS author, published_at, duration AS s FROM u),
p AS (SELECT q.id AS query_id, c.id AS candidate_id, len(list_intersect(q.w, c.w)) AS shared, len(list_distinct(list_concat(q.w, c.w))) AS either, q.s AS qs, abs(q.s - c.s) * 100 AS off, q.author AS qa, c.author AS ca, q.published_at AS qp, c.published_at AS cp
  FROM d q JOIN d c ON TRY_CAST(regexp_extract(q.id, '(\d+)', 1) AS BIGINT) % 100 = 0 AND q.id <> c.id),
z AS (SELECT query_id, candidate_id, CAST(greatest(0, least(100, CASE WHEN either > 0 THEN 70 * shared // either ELSE 0 END + CASE WHEN off <= 5 * qs THEN 15 WHEN off <= 15 * qs THEN 8 WHEN off <= 30 * qs THEN 3 ELSE 0 END
  + CASE WHEN qa = ca AND qa NOT IN ('', 'unknown', 'n/a', '-') THEN 10 ELSE 0 END + CASE WHEN cp >= qp THEN 5 ELSE 0 END - CASE WHEN shared = 0 THEN 12 ELSE 0 END)) AS INT) AS score FROM p),
ranked AS (SELECT query_id, rank, candidate_id, score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' WHEN score >= 40 THEN 'low' ELSE 'none' END AS band
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM z WHERE score > 0) WHERE rank <= 5)
"""

QUERIES = {f.__name__: f for f in (duplicate_candidates, candidate_bands)}
SQL = {"duplicate_candidates": f"{_RANKED} SELECT * FROM ranked", "candidate_bands": f"{_RANKED} SELECT band, count(*) AS n_candidates, count(DISTINCT query_id) AS n_queries FROM ranked GROUP BY 1"}
