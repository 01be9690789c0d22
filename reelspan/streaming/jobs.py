"""A store of jobs as relations: rows are appended, the state is what they say last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.operators.records import first_per_key


def current_jobs(updates: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``*key, status, progress, completed_at, n_updates`` of updates in which a null leaves a field as it is.

    The last status and progress that were set, progress within 0 to 100, and the first completion. Aggregations with partial results, so
    a job with any number of updates is no one task; applying a row twice changes only the count.
    """
    at = F.struct(*order)
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))["v"]
    return updates.groupBy(*key).agg(
        last("status").alias("status"), F.greatest(F.lit(0), F.least(F.lit(100), last("progress"))).alias("progress"), F.min("completed_at").alias("completed_at"), F.count(F.lit(1)).alias("n_updates"),
    )


def event_tail(events: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` events of each key, numbered in the order they came. ``n`` is the feature."""
    rows = first_per_key(events, key, [F.desc(c) for c in order], n, "_back")
    counts = rows.groupBy(*key).agg(F.max("_back").alias("_n"))
    return rows.join(counts, key).withColumn("seq", F.col("_n") - F.col("_back") + 1).drop("_n", "_back")


def with_heartbeats(jobs: DataFrame, beats: DataFrame, *, lease_ms: int, least_ms: int = 30_000) -> DataFrame:
    """``jobs`` whose lease lasts from their last heartbeat (``job_id, at_ms``), ``least_ms`` at least; late beats shorten nothing."""
    last = beats.groupBy("job_id").agg(F.max("at_ms").alias("_at"))
    lease = F.col("_at") + max(lease_ms, least_ms)
    return jobs.join(last, "job_id", "left").withColumn("lease_until_ms", F.greatest("lease_until_ms", lease)).drop("_at")


def claim(jobs: DataFrame, now_ms: int, *, lease_ms: int, worker: Column) -> DataFrame:
    """The one job to run next, marked as running: the oldest that waits, or whose lease has run out."""
    free = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_until_ms") < now_ms))
    return jobs.where(free).orderBy("created_ms", "job_id").limit(1).withColumns({"status": F.lit("running"), "lease_until_ms": F.lit(now_ms + lease_ms), "worker": worker})
