"""Neighbours, running sums and islands along the time of an entity, in shards so that no entity is one task.

Every operator here orders rows inside (entity, shard) and carries over shard boundaries what one row a shard can
carry. A shard is a stretch of time, so its size doesn't grow with the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_MS = 600_000
ORDER = ("start_ms", "end_ms", "id")


def _sharded(df: DataFrame, order: tuple[str, ...], shard_ms: int) -> DataFrame:
    return df.withColumn("_shard", F.floor(F.col(order[0]) / shard_ms))


def neighbours(df: DataFrame, entity: list[str], fields: list[str], *, order: tuple[str, ...] = ORDER, before: bool = True, after: bool = True, shard_ms: int = SHARD_MS) -> DataFrame:
    """``df`` with structs ``prev`` and ``next`` of the neighbours' ``fields`` in the entity's order, null at the ends.

    Cases: rows need the first order column; ties are broken by the rest of ``order``, which should make rows
    unique; a null entity is one. Columns ``prev``, ``next`` and ``_shard`` are replaced.
    """
    inside = Window.partitionBy(*entity, "_shard").orderBy(*order)
    row = F.struct(*fields)
    out = _sharded(df, order, shard_ms)
    key = F.struct(*order)
    edges = out.groupBy(*entity, "_shard").agg(F.min_by(row, key).alias("_first"), F.max_by(row, key).alias("_last"))
    along = Window.partitionBy(*entity).orderBy("_shard")
    edges = edges.select(*entity, "_shard", F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in entity] + [F.col("l._shard") == F.col("r._shard")]
    keep = [F.col(f"l.{c}") for c in df.columns if c not in ("prev", "next")]
    joined = out.alias("l").join(edges.alias("r"), same).select(*keep, F.col("l._shard").alias("_shard"), "r._before", "r._after")
    if before:
        joined = joined.withColumn("prev", F.coalesce(F.lag(row).over(inside), F.col("_before")))
    if after:
        joined = joined.withColumn("next", F.coalesce(F.lead(row).over(inside), F.col("_after")))
    return joined.drop("_shard", "_before", "_after")


def running_sums(df: DataFrame, entity: list[str], values: dict[str, Column], *, order: tuple[str, ...] = ORDER, shard_ms: int = SHARD_MS) -> DataFrame:
    """``df`` with a column for each of ``values``: its sum over the entity's rows up to and with each row, in one pass."""
    inside = Window.partitionBy(*entity, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    names = list(values)
    out = _sharded(df.drop(*names), order, shard_ms).withColumns({f"_v{k}": values[n].cast("bigint") for k, n in enumerate(names)})
    sums = out.groupBy(*entity, "_shard").agg(*[F.sum(f"_v{k}").alias(f"_total{k}") for k in range(len(names))])
    along = Window.partitionBy(*entity).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*entity, "_shard", *[F.coalesce(F.sum(f"_total{k}").over(along), F.lit(0)).alias(f"_offset{k}") for k in range(len(names))])
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in entity] + [F.col("l._shard") == F.col("r._shard")]
    joined = out.alias("l").join(sums.alias("r"), same).select("l.*", *[f"r._offset{k}" for k in range(len(names))])
    joined = joined.withColumns({n: F.coalesce(F.sum(f"_v{k}").over(inside), F.lit(0)) + F.col(f"_offset{k}") for k, n in enumerate(names)})
    return joined.drop("_shard", *[f"_{x}{k}" for x in ("v", "offset") for k in range(len(names))])


def running_sum(df: DataFrame, entity: list[str], value: Column, name: str, *, order: tuple[str, ...] = ORDER, shard_ms: int = SHARD_MS) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the entity's rows up to and with each row."""
    return running_sums(df, entity, {name: value}, order=order, shard_ms=shard_ms)


def running_last(df: DataFrame, entity: list[str], value: Column, name: str, *, order: tuple[str, ...] = ORDER, shard_ms: int = SHARD_MS) -> DataFrame:
    """``df`` with ``name``: the last value that isn't null before each row of the entity."""
    inside = Window.partitionBy(*entity, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = _sharded(df, order, shard_ms).withColumn("_v", value)
    lasts = out.where("_v IS NOT NULL").groupBy(*entity, "_shard").agg(F.max_by("_v", F.struct(*order)).alias("_end"))
    shards = out.select(*entity, "_shard").distinct()
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in entity] + [F.col("l._shard") == F.col("r._shard")]
    along = Window.partitionBy(*entity).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = shards.alias("l").join(lasts.alias("r"), same, "left").select(*[F.col(f"l.{c}") for c in [*entity, "_shard"]], "r._end")
    carried = carried.select(*entity, "_shard", F.last("_end", ignorenulls=True).over(along).alias("_carry"))
    joined = out.alias("l").join(carried.alias("r"), same).select(*[F.col(f"l.{c}") for c in df.columns if c != name], F.col("l._shard").alias("_shard"), "l._v", "r._carry")
    return joined.withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_carry"))).drop("_shard", "_v", "_carry")


def running_max(df: DataFrame, entity: list[str], value: Column, name: str, *, order: tuple[str, ...] = ORDER, shard_ms: int = SHARD_MS) -> DataFrame:
    """``df`` with ``name``: the greatest value before each row of the entity, null for the first."""
    inside = Window.partitionBy(*entity, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = _sharded(df.drop(name), order, shard_ms).withColumn("_v", value)
    along = Window.partitionBy(*entity).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    most = out.groupBy(*entity, "_shard").agg(F.max("_v").alias("_m")).select(*entity, "_shard", F.max("_m").over(along).alias("_carry"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in entity] + [F.col("l._shard") == F.col("r._shard")]
    joined = out.alias("l").join(most.alias("r"), same).select("l.*", "r._carry")
    return joined.withColumn(name, F.greatest(F.max("_v").over(inside), F.col("_carry"))).drop("_shard", "_v", "_carry")


def islands(df: DataFrame, entity: list[str], starts: Column, name: str, *, order: tuple[str, ...] = ORDER, shard_ms: int = SHARD_MS) -> DataFrame:
    """``df`` with ``name``: the number of the island each row belongs to, counted from 1; ``starts`` says which rows open one (the first always does)."""
    return running_sum(df, entity, F.when(starts, 1).otherwise(0), name, order=order, shard_ms=shard_ms)


def renumber(df: DataFrame, entity: list[str], name: str = "seq", *, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``df`` with ``name``: 1, 2, … in the entity's order."""
    return running_sum(df, entity, F.lit(1), name, order=order)


def first_mentions(mentions: DataFrame, entity: list[str], *, order: tuple[str, ...] = ORDER) -> DataFrame:
    """One row an entity and key: its first mention. An aggregation with partial minima, no sort of a whole entity."""
    rest = [c for c in mentions.columns if c not in entity]
    return mentions.groupBy(*entity).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*entity, *[F.col(f"_x.{c}").alias(c) for c in rest])
