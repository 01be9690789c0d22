"""Joins of intervals with intervals and of points with intervals, as equi-joins on buckets of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_MS = 10_000
#: Each level's buckets are so many times as wide as the level's below.
FACTOR = 64
_LEVELS = 7


def overlap_join(left: DataFrame, right: DataFrame, key: str, *, start: str = "start_ms", end: str = "end_ms", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of rows of one ``key`` whose intervals overlap, with ``overlap_ms``; columns ``l`` and ``r`` are structs of the rows.

    Both sides are written to the buckets of time they touch and joined on (key, level, bucket). An interval's level is that at which it
    touches at most 65 buckets; a pair meets at the higher of its two levels, in the first bucket that both touch, so nothing
    comes out twice and a row that lasts a year costs what a short one does. One aggregate tells which levels there are; commonly one.

    Cases: null times and ends not after the start overlap nothing; null keys match nothing; empty sides give no pairs.
    """

    def cut(df: DataFrame, side: str) -> DataFrame:
        ok = df.where(F.col(key).isNotNull() & F.col(start).isNotNull() & (F.col(end) > F.col(start)))
        length = F.col(end) - F.col(start)
        level = sum((F.when(length >= bucket_ms * FACTOR ** (k + 1), 1).otherwise(0) for k in range(_LEVELS - 1)), F.lit(0))
        return ok.select(F.struct(*df.columns).alias(side), F.col(key).alias("_k"), F.col(start).alias(f"_{side}s"), F.col(end).alias(f"_{side}e"), level.alias(f"_{side}n"))

    a, b = cut(left, "l"), cut(right, "r")
    top = max(a.agg(F.max("_ln")).first()[0] or 0, b.agg(F.max("_rn")).first()[0] or 0)

    def written(df: DataFrame, side: str) -> DataFrame:
        out = df.withColumn("_n", F.explode(F.sequence(F.col(f"_{side}n"), F.lit(top))) if top else F.lit(0))
        size = F.pow(F.lit(float(FACTOR)), F.col("_n")) * bucket_ms
        return out.withColumn("_b", F.explode(F.sequence(F.floor(F.col(f"_{side}s") / size), F.floor((F.col(f"_{side}e") - 1) / size))))

    met = written(a, "l").join(written(b, "r"), ["_k", "_n", "_b"])
    shared = F.least("_le", "_re") - F.greatest("_ls", "_rs")
    size = F.pow(F.lit(float(FACTOR)), F.col("_n")) * bucket_ms
    once = (F.col("_n") == F.greatest("_ln", "_rn")) & (F.col("_b") == F.floor(F.greatest("_ls", "_rs") / size))
    return met.where(once & (shared > 0)).select("l", "r", shared.alias("overlap_ms"))


def best_overlap(left: DataFrame, right: DataFrame, key: str, left_id: list[str], right_id: str, *, min_ratio: float = 0.35, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """For each left row the right row it overlaps most, by the share of its own time, if that is at least ``min_ratio``.

    Columns ``l``, ``r``, ``overlap_ms``. Ties go to the right row that starts first, then to the lesser ``right_id``. The best is an
    aggregation with partial maxima, so a row with a million partners isn't gathered.
    """
    pairs = overlap_join(left, right, key, start=start, end=end)
    rank = F.struct(F.col("overlap_ms").alias("_o"), (-F.col(f"r.{start}")).alias("_s"), (-F.col(f"r.{right_id}")).alias("_i"))
    best = pairs.groupBy(*[F.col(f"l.{c}").alias(f"_{c}") for c in left_id]).agg(F.max_by(F.struct("l", "r", "overlap_ms"), rank).alias("_x"))
    out = best.select("_x.l", "_x.r", "_x.overlap_ms")
    return out.where(F.col("overlap_ms") >= min_ratio * (F.col(f"l.{end}") - F.col(f"l.{start}")))


def chunk_of(middle_ms: Column, core_ms: int, total_ms: Column) -> Column:
    """The chunk (from 0) whose core holds a point; cores are half-open, the last holds its end too."""
    last = F.greatest(F.ceil(total_ms / core_ms) - 1, F.lit(0))
    return F.least(F.greatest(F.floor(middle_ms / core_ms), F.lit(0)), last)


def chunk_plan(totals: DataFrame, total_ms: str, *, core_ms: int = 480_000, overlap_ms: int = 1_000) -> DataFrame:
    """``totals`` with a row for each chunk: ``chunk, core_start_ms, core_end_ms, start_ms, end_ms, is_last``; chunks reach ``overlap_ms`` into their neighbours."""
    last = F.greatest(F.ceil(F.col(total_ms) / core_ms) - 1, F.lit(0))
    out = totals.where(F.col(total_ms) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    out = out.withColumn("core_start_ms", F.col("chunk") * core_ms).withColumn("core_end_ms", F.least(F.col("core_start_ms") + core_ms, F.col(total_ms)))
    return out.withColumn("start_ms", F.greatest(F.col("core_start_ms") - overlap_ms, F.lit(0))).withColumn("end_ms", F.least(F.col("core_end_ms") + overlap_ms, F.col(total_ms))).withColumn("is_last", F.col("chunk") == last)
