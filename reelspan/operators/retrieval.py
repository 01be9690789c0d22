"""Candidates that may be copies of a video: scored by title, length, author and date, ranked for a stated set of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.text import name_key

# Scores from which a candidate is held as likely; authors that name nobody; words of titles that say little.
BANDS = (("high", 80), ("medium", 60), ("low", 40))
NO_AUTHOR = ("", "unknown", "n/a", "-")
GENERIC = ("a", "an", "and", "guide", "of", "part", "review", "story", "the", "to", "video")


def title_words(title: Column) -> Column:
    """Different words of a title that aren't generic; null has none."""
    words = F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*GENERIC))
    return F.array_distinct(words)


def _score() -> Column:
    shared, either = F.size(F.array_intersect("q.words", "c.words")), F.size(F.array_union("q.words", "c.words"))
    off = F.abs(F.col("q.seconds") - F.col("c.seconds")) * 100
    length = F.when(off <= 5 * F.col("q.seconds"), 15).when(off <= 15 * F.col("q.seconds"), 8).when(off <= 30 * F.col("q.seconds"), 3).otherwise(0)
    author = F.when((F.col("q.author") == F.col("c.author")) & ~F.col("q.author").isin(*NO_AUTHOR), 10).otherwise(0)
    after = F.when(F.col("c.published_at") >= F.col("q.published_at"), 5).otherwise(0)
    title = F.when(either > 0, F.floor(70 * shared / F.greatest(either, F.lit(1)))).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), title + length + author + after - F.when(shared == 0, 12).otherwise(0))).cast("int")


def ranked_candidates(queries: DataFrame, rows: DataFrame, *, k: int = 5, block: int = 1000) -> DataFrame:
    """``query_id, rank, candidate_id, score, band`` of the ``k`` best of ``rows`` for each query, itself excepted; ties in order of id.

    ``id, title, author, published_at, duration``. The queries are a stated, small set, sent to every task in blocks; rows are scanned once a block and only each task's best
    are shuffled. Null titles share no words; null durations, authors and dates add nothing. Candidates without any score don't come out.
    """
    def cut(df: DataFrame) -> DataFrame:
        return df.select("id", title_words(F.col("title")).alias("words"), name_key(F.col("author")).alias("author"), "published_at", F.col("duration").alias("seconds"))

    n, asked, held = queries.count(), cut(queries), cut(rows)
    parts = max(1, -(-n // block))
    out = None
    for at in range(parts):
        part = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == at)
        met = F.broadcast(part).alias("q").join(held.alias("c"), F.col("q.id") != F.col("c.id"))
        scored = met.select(F.col("q.id").alias("query_id"), F.col("c.id").alias("candidate_id"), _score().alias("score")).where("score > 0")
        best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id"))).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    band = F.coalesce(*[F.when(F.col("score") >= least, F.lit(name)) for name, least in BANDS], F.lit("none"))
    return out.select("query_id", "rank", "candidate_id", "score", band.alias("band"))


def score_histogram(ranked: DataFrame) -> DataFrame:
    """Candidates and queries by band."""
    return ranked.groupBy("band").agg(F.count(F.lit(1)).alias("n_candidates"), F.countDistinct("query_id").alias("n_queries"))
