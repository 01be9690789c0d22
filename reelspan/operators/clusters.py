"""Spans that lie close together, as clusters to repair in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.operators.sequences import running_last, running_max, running_sum


def repair_clusters(spans: DataFrame, *, gap: int = 2, most: int = 24) -> DataFrame:
    """``video_id, first_id, last_id, n_spans, score``: spans (``video_id, span, start_id, end_id, score``) whose segments touch or lie at most ``gap`` ids apart, together.

    Chains of touching spans are islands along the ids, by the furthest end so far; one of more than ``most`` segments is cut into stretches of that many
    ids from its first. Orders run over shards of ids, so no video is one task.
    """
    rows = spans.withColumn("id", F.col("span"))
    order = ("start_id", "end_id", "id")
    shard = {"order": order, "shard_ms": 2_000}
    rows = running_max(rows, ["video_id"], F.col("end_id"), "_reach", **shard)
    rows = rows.withColumn("_opens", F.coalesce(F.col("start_id") - F.col("_reach") > gap, F.lit(True)))
    rows = running_sum(rows, ["video_id"], F.when(F.col("_opens"), 1).otherwise(0), "_chain", **shard)
    first = F.when(F.col("_opens"), F.col("start_id"))
    rows = running_last(rows, ["video_id"], first, "_first", **shard).withColumn("_first", F.coalesce(first, F.col("_first")))
    rows = rows.withColumn("_part", F.floor((F.col("start_id") - F.col("_first")) / most))
    return rows.groupBy("video_id", "_chain", "_part").agg(F.min("start_id").alias("first_id"), F.max("end_id").alias("last_id"), F.count(F.lit(1)).alias("n_spans"), F.sum("score").alias("score")).drop("_chain", "_part")
