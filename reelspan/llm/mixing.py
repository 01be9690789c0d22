"""Mixing sources to target weights by replicating documents a Poisson number of times."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.functions.text import name_key


def poisson_steps(mean: float, most: int) -> list[float]:
    """Distribution function at 0 .. most-1 of the Poisson number capped at ``most`` whose mean is ``mean``.

    The cap lowers the mean, so the rate is the one at which the capped mean is right (by
    bisection); a mean at or over the cap gives the constant ``most``.
    """
    if most <= 0 or mean <= 0:
        return [1.0] * max(0, most)
    if mean >= most:
        return [0.0] * most

    def steps(rate: float) -> list[float]:
        out, total = [], 0.0
        for k in range(most):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            out.append(min(1.0, total))
        return out

    low, high = mean, max(2 * mean, 1.0)
    capped = lambda rate: most - sum(steps(rate))
    while capped(high) < mean and high < 1e9:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped(mid) < mean else (low, mid)
    return steps(high)


def mix_sources(docs: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", source: str = "source", size: str = "size", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mixed documents in global random order (``doc_id, source, copy, size``), and a report per target source.

    The mix is as large as all documents. Each document of a source is repeated as often as the
    inverse of its source's Poisson distribution says at a uniform number hashed from the document's id
    and the seed: whole rows, no joins among documents, the same on every run. A source that cannot
    reach its share gives every document ``max_repeats`` times. The only shuffles are the sizes per source (summed before) and the final order.

    Report: ``source, target_share, max_repeats, size, reachable, mean_repeats, mixed_size, actual_share``.

    Cases: sources are compared folded and lower-cased; targets of one name count once (the
    first in order of share); documents without a target, with a null source or without size add to the whole, aren't
    mixed; null or negative sizes are 0; a null or negative share or cap is 0; a source without documents
    has size 0; rows with repeated ids are repeated alike; no documents: nothing mixed, shares null.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("_id"), name_key(F.col(source)).alias("_source"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("_size"))
    goals = targets.select(name_key(F.col("source")).alias("_source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("_most"))
    goals = goals.where("_source IS NOT NULL").groupBy("_source").agg(F.max(F.struct("_share", "_most")).alias("_x")).select("_source", "_x._share", "_x._most")
    sizes = base.groupBy("_source").agg(F.sum("_size").alias("_have"))
    whole = sizes.agg(F.coalesce(F.sum("_have"), F.lit(0)).alias("_whole"))
    plan = goals.join(sizes, "_source", "left").na.fill(0, ["_have"]).crossJoin(F.broadcast(whole)).collect()  # a row for each target
    rows = []
    for r in plan:
        goal = r["_share"] * r["_whole"]
        mean = goal / r["_have"] if r["_have"] else 0.0
        reachable = r["_most"] * r["_have"] >= goal
        rows.append((r["_source"], r["_share"], int(r["_most"]), int(r["_have"]), reachable, float(min(mean, r["_most"])), poisson_steps(mean, int(r["_most"]))))
    table = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, size bigint, reachable boolean, mean_repeats double, _steps array<double>")

    chance = (F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = (
        base.where("_size > 0").withColumnRenamed("_source", "source").join(table.select("source", "_steps"), "source")
        .withColumn("_u", chance).withColumn("_times", F.expr("size(filter(_steps, s -> s <= _u))")).where("_times > 0")
    )
    mixed = drawn.select(F.col("_id").alias(doc_id), "source", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("copy"), F.col("_size").alias("size"))
    reached = drawn.groupBy("source").agg(F.sum(F.col("_size") * F.col("_times")).alias("mixed_size"))
    total = reached.agg(F.sum("mixed_size").alias("_total"))
    report = (
        table.drop("_steps").join(reached, "source", "left").na.fill(0, ["mixed_size"]).crossJoin(F.broadcast(total))
        .withColumn("actual_share", F.col("mixed_size") / F.col("_total")).drop("_total")
    )
    return mixed.orderBy(F.xxhash64(doc_id, "copy", F.lit(seed + 1)), doc_id, "copy"), report
