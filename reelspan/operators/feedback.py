"""Records of human edits: identity, duplicates, conflicts, selection, evaluation, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions import rules as R


def map_text(column: str) -> Column:
    """The entries of a map of texts in order of their keys, ``key:value`` joined by |; null is empty."""
    entries = F.array_sort(F.map_entries(F.coalesce(F.col(column), F.create_map().cast("map<string,string>"))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e.key, F.lit(":"), F.coalesce(e.value, F.lit("")))), "|")


def record_key() -> Column:
    """What makes a span record one: project, span, segments, source and manual targets."""
    ids = F.array_join(F.coalesce(F.col("segment_ids"), F.array().cast("array<bigint>")).cast("array<string>"), ",")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat_ws("::", text("project_id"), text("span_id"), ids, text("source_joined"), map_text("manual_target_by_id"))


def best_per_key(df: DataFrame, key: Column, priority: Column) -> DataFrame:
    """One record a key: that of highest priority; ties go to the least of the ordering columns in ``priority``."""
    return df.withColumn("_key", key).groupBy("_key").agg(F.max_by(F.struct(*df.columns), priority).alias("_x")).select("_key", *[F.col(f"_x.{c}").alias(c) for c in df.columns])


def append_new(existing: DataFrame, batch: DataFrame, key: Column, order: Column) -> DataFrame:
    """Records of ``batch`` whose key ``existing`` lacks, the first of each key."""
    fresh = best_per_key(batch, key, -order)
    return fresh.join(existing.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def upsert(existing: DataFrame, batch: DataFrame, key: Column, order: Column) -> DataFrame:
    """``existing`` with records of ``batch`` in place of those with their key, the last of each key, and the new ones added."""
    last = best_per_key(batch, key, order)
    return existing.withColumn("_key", key).join(last.select("_key"), "_key", "left_anti").unionByName(last).drop("_key")


def same_and_different(records: DataFrame, source: Column, machine: Column, manual: Column) -> DataFrame:
    """Groups of records, ``kind, source, text, n_records, n_variants``: 'duplicate' (all three texts equal), 'conflict' (equal source and
    machine text, different manual texts), 'merge' (equal source and manual text, different machine texts). Records without any text don't count."""
    clean = lambda c: F.lower(R.squash(c))
    rows = records.select(clean(source).alias("s"), clean(machine).alias("m"), clean(manual).alias("h")).where("s <> '' OR m <> '' OR h <> ''")
    full = rows.groupBy("s", "m", "h").agg(F.count(F.lit(1)).alias("n"))  # every kind is computed from this one aggregate
    n = F.col("n_records")
    duplicates = full.where("n > 1").select(F.lit("duplicate").alias("kind"), F.col("s").alias("source"), F.concat_ws(" => ", "m", "h").alias("text"), F.col("n").alias("n_records"), F.lit(1).cast("bigint").alias("n_variants"))
    conflicts = full.groupBy("s", "m").agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_variants")).where("n_variants > 1").select(F.lit("conflict").alias("kind"), F.col("s").alias("source"), F.col("m").alias("text"), n, "n_variants")
    merges = full.groupBy("s", "h").agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_variants")).where("n_variants > 1").select(F.lit("merge").alias("kind"), F.col("s").alias("source"), F.col("h").alias("text"), n, "n_variants")
    return duplicates.unionByName(conflicts).unionByName(merges)


def prompt_examples(records: DataFrame) -> DataFrame:
    """Records that may be shown as examples: accepted, meant for prompts, without a flag of bad alignment. Null flags are no."""
    return records.where(F.coalesce("accepted", F.lit(False)) & F.coalesce("use_for_span_prompt", F.lit(False)) & ~F.coalesce(F.array_contains("quality_flags", "bad_alignment"), F.lit(False)))


def reason_totals(records: DataFrame) -> DataFrame:
    """Risk reasons over all records: records that have each, and the sum of its counts."""
    return records.select(F.explode("risk_reasons").alias("reason", "k")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_records"), F.sum("k").cast("bigint").alias("total"))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def example_score(a: str, b: str) -> Column:
    """How well record ``b`` serves as an example for span ``a``: shared reasons, strategy, words, size and duration."""
    col = lambda side, c: F.col(f"{side}.{c}")
    keys = lambda side: F.map_keys(F.coalesce(col(side, "risk_reasons"), F.create_map().cast("map<string,int>")))
    both, either = F.size(F.array_intersect(col(a, "words"), col(b, "words"))), F.size(F.array_union(col(a, "words"), col(b, "words")))
    size = lambda side: F.size(F.coalesce(col(side, "segment_ids"), F.array().cast("array<bigint>")))
    gap = F.abs(col(a, "duration_ms") - col(b, "duration_ms"))
    return (
        8 * F.size(F.array_intersect(keys(a), keys(b))) + F.when(col(a, "translation_strategy") == col(b, "translation_strategy"), 10).otherwise(0)
        + F.coalesce(F.floor(20 * both / F.nullif(either, F.lit(0))), F.lit(0)) + F.greatest(F.lit(0), 6 - 2 * F.abs(size(a) - size(b))) + F.coalesce(F.greatest(F.lit(0), 5 - F.floor(gap / 1000)), F.lit(0))
    ).cast("bigint")


def similar_examples(queries: DataFrame, records: DataFrame, *, k: int = 5, block: int = 1000) -> DataFrame:
    """``query_id, rank, example_id, score``: the ``k`` records that serve each query best, itself excepted; ties in order of id.

    The queries are a stated, small set and go to every task in blocks of at most ``block``; the records are scanned
    once a block and never shuffled but for each task's best.
    """
    n = queries.count()
    out = None
    for at in range(0, max(n, 1), block):
        part = queries if n <= block else queries.where(F.pmod(F.xxhash64("example_id"), F.lit(-(-n // block))) == at // block)
        met = F.broadcast(part).alias("q").join(records.alias("e"), F.col("q.example_id") != F.col("e.example_id"))
        scored = met.select(F.col("q.example_id").alias("query_id"), F.col("e.example_id").alias("example_id"), (F.col("q.project_id") == F.col("e.project_id")).alias("same_project"), example_score("q", "e").alias("score")).where("score > 0")
        best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "example_id"))).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out.select("query_id", "rank", "example_id", "same_project", "score")


def ranking_quality(ranked: DataFrame, *, at: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: queries, share with a hit among the first k for each k (in parts per million), and mean reciprocal rank of the first hit (too); zeros without queries."""
    first = ranked.groupBy("query_id").agg(F.min(F.when(F.col("same_project"), F.col("rank"))).alias("r"))
    share = lambda k: F.coalesce(F.floor(F.try_divide(F.count_if(F.col("r") <= k) * 1_000_000, F.count(F.lit(1)))), F.lit(0))
    return first.agg(F.count(F.lit(1)).alias("n_queries"), *[share(k).alias(f"recall_{k}_ppm") for k in at], F.coalesce(F.floor(F.try_divide(F.sum(F.coalesce(F.floor(1_000_000 / F.col("r")), F.lit(0))), F.count(F.lit(1)))), F.lit(0)).alias("mrr_ppm"))


def edit_summary(pairs: DataFrame) -> DataFrame:
    """One row over pairs of machine and manual text: how many, changed, changed in punctuation only, mean likeness (in parts per million) and mean change of length."""
    plain = lambda c: F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{N}]+", "")
    changed = F.col("machine") != F.col("manual")
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(changed).alias("n_changed"), F.count_if(changed & (plain("machine") == plain("manual"))).alias("n_surface_only"),
        F.coalesce(F.sum(F.floor(R.multiset_similarity(F.col("machine"), F.col("manual")) * 10000)), F.lit(0)).cast("bigint").alias("similarity_sum_e4"),
        F.coalesce(F.sum(F.abs(F.length("machine") - F.length("manual"))), F.lit(0)).cast("bigint").alias("abs_delta_sum"),
    )


def merge_candidates(rows: DataFrame, key: str, order: list[str], first: list[str], gather: list[str]) -> DataFrame:
    """One row a key: of columns ``first`` the earliest value that isn't blank, of ``gather`` all values that aren't, distinct and sorted, joined by |, and ``n_rows``.

    Every part is an aggregation with partial results; gathered lists hold distinct values only.
    """
    value = lambda c: F.when(F.trim(c) != "", F.struct(*order, F.trim(c).alias("v")))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), *[F.min(value(c))["v"].alias(c) for c in first], *[F.array_join(F.array_sort(F.collect_set(F.when(F.trim(c) != "", F.trim(c)))), "|").alias(f"all_{c}") for c in gather])


def top_counts(rows: DataFrame, value: Column, order: list[str], k: int) -> DataFrame:
    """``value, n``: the ``k`` most frequent values, ties by first occurrence. Null and blank values don't count."""
    counts = rows.select(value.alias("value"), *order).where(F.trim("value") != "").groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(k).select("value", "n")


def edit_tags(machine: Column, manual: Column) -> Column:
    """What an edit did: unchanged, surface (punctuation, case or blanks only), compressed or expanded (by a fifth or more), numbers, latin (Latin words taken out)."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    a, b, changed = F.length(plain(machine)), F.length(plain(manual)), machine != manual
    tags = [
        ("unchanged", ~changed), ("surface", changed & (plain(machine) == plain(manual))), ("compressed", changed & (b * 5 <= a * 4)), ("expanded", changed & (b * 4 >= a * 5)),
        ("numbers", F.array_sort(R.numbers(machine)) != F.array_sort(R.numbers(manual))), ("latin", machine.rlike("[A-Za-z]{2}") & ~manual.rlike("[A-Za-z]{2}")),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(t)) for t, cond in tags]))
