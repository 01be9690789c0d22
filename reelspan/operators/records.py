"""Records of edits: rules they must keep, gold sets, samples to evaluate, updates of many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.operators.feedback import best_per_key

#: Parts into which a key's rows are spread before its first ones are chosen.
SALTS = 16


def first_per_key(rows: DataFrame, key: list[str], order: list[Column], n: int, name: str = "place") -> DataFrame:
    """The first ``n`` rows of each key in an order, with their ``name``, counted from 1. ``n`` is the feature.

    Chosen in two steps: each part of a key's rows keeps its first ``n``, then the key of those; a key with a third of all rows is no one task.
    """
    columns = [F.col(c) for c in rows.columns]
    parts = rows.withColumn("_salt", F.pmod(F.xxhash64(F.to_json(F.struct(*columns))), F.lit(SALTS)))
    parts = parts.withColumn(name, F.row_number().over(Window.partitionBy(*key, "_salt").orderBy(*order))).where(F.col(name) <= n).drop("_salt")
    return parts.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(name) <= n)


def violations(records: DataFrame) -> DataFrame:
    """``example_id, rule`` for each rule that a span record breaks.

    Required fields, a list of segments that isn't empty, maps and flags that are there, machine and manual targets of the record's own segments only, an
    end after the start, and no use as an example before acceptance.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    ids = F.transform(F.coalesce("segment_ids", F.array().cast("array<bigint>")), lambda x: x.cast("string"))
    foreign = lambda c: F.size(F.array_except(F.map_keys(F.coalesce(c, F.create_map().cast("map<string,string>"))), ids)) > 0
    rules = {
        **{f"missing_{c}": blank(c) for c in ("project_id", "span_id", "source_joined", "translation_strategy")},
        **{f"missing_{c}": F.col(c).isNull() for c in ("risk_reasons", "machine_target_by_id", "manual_target_by_id", "accepted", "use_for_span_prompt", "created_at")},
        "empty_segment_ids": F.size(F.coalesce("segment_ids", F.array().cast("array<bigint>"))) == 0, "machine_target_of_other_segment": foreign("machine_target_by_id"), "manual_target_of_other_segment": foreign("manual_target_by_id"),
        "end_not_after_start": F.col("end_s") <= F.col("start_s"), "used_before_accepted": F.coalesce(F.col("use_for_span_prompt"), F.lit(False)) & ~F.coalesce(F.col("accepted"), F.lit(False)),
    }
    return records.select("example_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(rule)) for rule, broken in rules.items()]))).alias("rule"))


def validation(records: DataFrame, key: Column) -> DataFrame:
    """One row: records, keys, repeated records, records that break a rule."""
    bad = violations(records).agg(F.countDistinct("example_id").alias("n_invalid"))
    return records.agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct(key).alias("n_keys"), (F.count(F.lit(1)) - F.countDistinct(key)).alias("n_repeated")).crossJoin(F.broadcast(bad))  # one row each


def gold_records(records: DataFrame, key: Column) -> DataFrame:
    """Accepted records that serve as no example and break no rule, one a key, the earliest."""
    wanted = records.where(F.col("accepted") & ~F.coalesce(F.col("use_for_span_prompt"), F.lit(False))).join(violations(records).select("example_id").distinct(), "example_id", "left_anti")
    return best_per_key(wanted, key, F.struct((-F.unix_micros("created_at")).alias("t"), (-F.col("example_id")).alias("i")))


def evaluation_sample(records: DataFrame, kind: Column, order: Column, n: int) -> DataFrame:
    """``n`` records, half of each of two kinds (``kind`` true or false), filled up from the other where one has too few. ``n`` is the feature."""
    rows = records.withColumn("_kind", kind).withColumn("_o", order)
    placed = first_per_key(rows, ["_kind"], [F.col("_o")], n, "_place")
    half = F.when(F.col("_kind"), F.lit(n - n // 2)).otherwise(F.lit(n // 2))
    return placed.withColumn("_late", F.col("_place") > half).orderBy("_late", "_place", "_kind").limit(n).drop("_kind", "_o", "_place", "_late")


def bulk_updates(records: DataFrame, wanted: Column, action: str, order: Column, n: int) -> DataFrame:
    """``records`` after an action (accept, accept_prompt, reject) on the first ``n`` that are wanted and that it changes.

    Use as an example implies acceptance; a rejected record is no example. Records that the action leaves as they are don't count towards ``n``.
    """
    to = {"accept": (True, None), "accept_prompt": (True, True), "reject": (False, False)}[action]
    new = F.struct(F.lit(to[0]).alias("accepted"), (F.coalesce(F.col("use_for_span_prompt"), F.lit(False)) if to[1] is None else F.lit(to[1])).alias("prompt"))
    changes = ~(F.coalesce(F.col("accepted"), F.lit(False)) == new["accepted"]) | ~(F.coalesce(F.col("use_for_span_prompt"), F.lit(False)) == new["prompt"])
    chosen = records.where(F.coalesce(wanted, F.lit(False)) & changes).orderBy(order).limit(n).select("example_id").distinct().withColumn("updated", F.lit(True))
    rows = records.join(chosen, "example_id", "left").withColumn("updated", F.coalesce("updated", F.lit(False)))
    pick = lambda field, old: F.when(F.col("updated"), new[field]).otherwise(F.coalesce(F.col(old), F.lit(False)))
    return rows.withColumns({"accepted": pick("accepted", "accepted"), "use_for_span_prompt": pick("prompt", "use_for_span_prompt")})


def style_profile(pairs: DataFrame) -> DataFrame:
    """One row a strategy of pairs (``strategy, machine, manual``): how many, how many changed, mean absolute difference of length in hundredths, longer and shorter ones."""
    delta = F.length("manual") - F.length("machine")
    return pairs.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("machine") != F.col("manual")).alias("n_changed"), F.round(100 * F.avg(F.abs(delta))).cast("bigint").alias("mean_delta_hundredths"),
        F.count_if(delta > 0).alias("n_longer"), F.count_if(delta < 0).alias("n_shorter"),
    )


def span_candidates(spans: DataFrame, locked: DataFrame, *, strategies: tuple[str, ...] = ("span_first",), most_spans: int = 16, most_segments: int = 4, max_ms: int = 12_000, least_score: int = 10) -> DataFrame:
    """``video_id, span, segment_ids, risk_score, place``: the spans of each video to translate as a whole, of highest score, with their segments that aren't locked. The bound is the feature."""
    wanted = spans.where(F.col("strategy").isin(*strategies) & (F.col("n_segments") <= most_segments) & (F.col("end_ms") - F.col("start_ms") <= max_ms) & (F.col("risk_score") >= least_score))
    ids = wanted.select("video_id", "span", "start_id", "risk_score", F.posexplode("segment_ids").alias("pos", "id")).join(locked.select("video_id", "id").distinct(), ["video_id", "id"], "left_anti")
    held = ids.groupBy("video_id", "span", "start_id", "risk_score").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x.id).alias("segment_ids"))
    return first_per_key(held, ["video_id"], [F.desc("risk_score"), F.col("start_id"), F.col("span")], most_spans).select("video_id", "span", "segment_ids", "risk_score", "place")
