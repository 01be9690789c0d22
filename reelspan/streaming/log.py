"""Event logs as streams: counts by time, sequence numbers, latest state by key, expired leases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """New files of a folder as a stream of events, ``ts`` as a timestamp."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, *, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events and their values by tumbling window and type; rows later than the watermark are left out."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 1000).cast("bigint")).alias("value_milli")).select(F.col("w.start").alias("window_start"), "event_type", "n", "value_milli")


def once_per_key(events: DataFrame, key: str, *, late: str = "1 day") -> DataFrame:
    """Each key once while the watermark remembers it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sequenced(events: DataFrame, key: str, order: str, *, payload: str) -> DataFrame:
    """``key, seq, order, payload``: a number for each event of a key, going on over batches. State is one number a key."""
    kind = {f.name: f.dataType.simpleString() for f in events.schema}

    def number(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values([order, payload], kind="stable")
        state.update((last + len(rows),))
        yield pd.DataFrame({key: [group[0]] * len(rows), "seq": range(last + 1, last + len(rows) + 1), order: rows[order].to_numpy(), payload: rows[payload].to_numpy()})

    return events.select(key, order, payload).groupBy(key).applyInPandasWithState(number, f"{key} {kind[key]}, seq bigint, {order} {kind[order]}, {payload} {kind[payload]}", "last bigint", "append", GroupStateTimeout.NoTimeout)


def latest_state(batch: DataFrame, stored: DataFrame | None, key: list[str], order: str) -> DataFrame:
    """Stored rows with those of a batch in place of older ones of their key. For ``foreachBatch``; applying a batch twice changes nothing."""
    every = batch if stored is None else stored.unionByName(batch)
    rest = [c for c in every.columns if c not in key]
    return every.groupBy(*key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_x")).select(*key, *[F.col(f"_x.{c}").alias(c) for c in rest])


def claimable(jobs: DataFrame, now_ms: int, *, waiting: tuple[str, ...] = ("queued",), held: tuple[str, ...] = ("running",)) -> DataFrame:
    """Jobs that may be taken, oldest first: waiting ones, and held ones whose lease has run out."""
    return jobs.where(F.col("status").isin(*waiting) | (F.col("status").isin(*held) & (F.col("lease_until_ms") < now_ms))).orderBy("created_ms", "job_id")


def run_available(stream: DataFrame, spark: SparkSession, checkpoint: str, *, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its rows from files under the checkpoint's folder; of complete results those of the last batch."""
    out = f"{checkpoint}/rows"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out)
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    writer.option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
