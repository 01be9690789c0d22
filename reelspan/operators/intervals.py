"""Continuous periods and gaps of interval rows, merged in two levels so that no entity is one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.runtime import cut_lineage

SHARD_MS = 600_000


def merge_intervals(df: DataFrame, entity: list[str], row_id: str, *, start: str = "start_ms", end: str = "end_ms", version: str | None = None, shard_ms: int = SHARD_MS) -> DataFrame:
    """Covered stretches of each entity, with how many rows cover them and where coverage ended before.

    Columns: ``*entity, start_ms, end_ms, n_rows, prev_end_ms`` (null for an entity's first stretch).
    Intervals that overlap or touch form one stretch.

    Level one clips every interval at the end of the time shard in which it starts and merges inside
    each (entity, shard); what reaches beyond a shard is kept only as the shard's furthest end. Level
    two runs over one row a shard: the furthest end so far says which local stretches continue
    coverage that came in over a boundary, and those are coalesced with the stretch that was open
    there. So a task of level one sees at most ``shard_ms`` distinct starts of one entity, and level
    two as many rows as the entity has shards, however many rows the entity has. An interval of any
    length costs one row.

    Cases: rows with a null time or an end not after the start don't count. Rows of one ``row_id``
    count once; of versions that differ, the one greatest in ``version`` and then in its times holds.
    A null entity is an entity of its own; null ids are one id. No rows, no stretches. Further columns are ignored.
    """
    times = F.struct(*([F.col(version)] if version else []), F.col(start), F.col(end))
    keys = [F.col(c) for c in entity]
    rows = (
        df.groupBy(*keys, F.col(row_id).alias("_id")).agg(F.max(times).alias("_t"))
        .select(*entity, F.col(f"_t.{start}").alias("_s"), F.col(f"_t.{end}").alias("_e"))
        .where("_s IS NOT NULL AND _e IS NOT NULL AND _e > _s")
        .withColumn("_shard", F.floor(F.col("_s") / shard_ms))
        .groupBy(*entity, "_shard", "_s").agg(F.max("_e").alias("_e"), F.count(F.lit(1)).alias("_n"))
    )
    inside = Window.partitionBy(*entity, "_shard").orderBy("_s")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = (
        rows.withColumn("_reach", F.max("_e").over(before))
        .withColumn("_island", F.sum(F.when(F.col("_reach").isNull() | (F.col("_s") > F.col("_reach")), 1).otherwise(0)).over(inside))
        .groupBy(*entity, "_shard", "_island").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_n").alias("_n"))
    )
    local = cut_lineage(local.select(*entity, "_shard", "_s", "_e", "_n"))

    along = Window.partitionBy(*entity).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = local.groupBy(*entity, "_shard").agg(F.max("_e").alias("_far")).withColumn("_in", F.max("_far").over(along)).drop("_far")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*entity, "_shard"]]
    pieces = (
        local.alias("l").join(carry.alias("r"), same).select("l.*", "r._in")
        .withColumn("_prev", F.greatest("_in", F.lag("_e").over(inside)))
        .withColumn("_root", F.when(F.col("_in").isNull() | (F.col("_s") > F.col("_in")), F.col("_s")))
    )
    pieces = cut_lineage(pieces.select(*entity, "_shard", "_root", "_e", "_n", "_prev"))

    opened = pieces.where("_root IS NOT NULL")
    boundary = pieces.groupBy(*entity, "_shard").agg(
        F.max("_root").alias("_last"),
        F.max(F.when(F.col("_root").isNull(), F.col("_e"))).alias("_e"),
        F.sum(F.when(F.col("_root").isNull(), F.col("_n"))).alias("_n"),
    )
    continued = boundary.withColumn("_root", F.last("_last", ignorenulls=True).over(along)).where("_n IS NOT NULL")
    return (
        opened.select(*entity, "_root", "_e", "_n", "_prev")
        .unionByName(continued.select(*entity, "_root", "_e", "_n", F.lit(None).cast("bigint").alias("_prev")))
        .groupBy(*entity, "_root").agg(F.max("_e").alias("end_ms"), F.sum("_n").alias("n_rows"), F.max("_prev").alias("prev_end_ms"))
        .select(*entity, F.col("_root").alias("start_ms"), "end_ms", "n_rows", "prev_end_ms")
    )


def periods_and_gaps(stretches: DataFrame, entity: list[str], *, min_rows: int = 2, min_gap_ms: int = 1500) -> DataFrame:
    """Of ``merge_intervals``: ``*entity, kind, start_ms, end_ms``; 'period' for stretches of ``min_rows`` rows
    or more, 'gap' for uncovered stretches of ``min_gap_ms`` or more between two neighbours."""
    period = F.when(F.col("n_rows") >= min_rows, F.struct(F.lit("period").alias("kind"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b")))
    gap = F.when(F.col("start_ms") - F.col("prev_end_ms") >= min_gap_ms, F.struct(F.lit("gap").alias("kind"), F.col("prev_end_ms").alias("a"), F.col("start_ms").alias("b")))
    found = stretches.select(*entity, F.explode(F.array_compact(F.array(period, gap))).alias("_x"))
    return found.select(*entity, F.col("_x.kind").alias("kind"), F.col("_x.a").alias("start_ms"), F.col("_x.b").alias("end_ms"))
