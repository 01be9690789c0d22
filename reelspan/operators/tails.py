"""Short tails of cues: what each is to the cue before it, and tails joined to what they end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions import rules as R
from reelspan.functions.wording import short_tail
from reelspan.operators.sequences import neighbours, running_last, running_sums


def tail_kinds(cues: DataFrame) -> DataFrame:
    """``video_id, cue_id, kind`` of timed cues: what each is to the one before it in time."""
    rows = cues.select("video_id", F.col("cue_id").alias("id"), "start_ms", "end_ms", R.squash(F.col("en_text")).alias("text"))
    near = neighbours(rows, ["video_id"], ["end_ms", "text"], after=False)
    gap = F.greatest(F.col("start_ms") - F.col("prev.end_ms"), F.lit(0))
    return near.select("video_id", F.col("id").alias("cue_id"), short_tail(F.col("prev.text"), F.col("text"), gap).alias("kind"))


def tidy_source_tail(text: Column) -> Column:
    """A full stop before a last word or two in small letters goes."""
    return F.regexp_replace(R.squash(text), r"([A-Za-z])\. +([a-z][A-Za-z0-9'-]*(?: +[a-z][A-Za-z0-9'-]*)?[.!?])$", "$1 $2")


def tidy_target_tail(text: Column) -> Column:
    """A stop or comma before a last bit of up to four signs goes, and so does a last bit that was already said."""
    t = F.regexp_replace(R.squash(text), "([一-龥])[。，]([一-龥]{1,4}。)$", "$1$2")
    part = lambda k: F.regexp_extract(t, "^(.*[。！？])([^。！？]{2,10})([。！？])$", k)
    return F.when((part(2) != "") & F.contains(part(1), part(2)), F.concat(F.regexp_replace(part(1), "[。！？]+$", ""), part(3))).otherwise(t)


def join_tails(cues: DataFrame, *, max_gap_ms: int = 1200, max_group_ms: int = 7700, max_chars: int = 92) -> DataFrame:
    """``video_id, cue_id, tail_id, start_ms, end_ms, en_text, zh_text``: timed cues in which an orphaned tail is joined to the cue before it; ``tail_id`` is the joined cue's, else null.

    Going through a video in order, a cue that takes its neighbour passes it over, so in a run of cues that could each take the next every other one
    does: its number in the run, from running values over shards of time, says which. No video is one task.
    """
    rows = cues.select("video_id", F.col("cue_id").alias("id"), "start_ms", "end_ms", R.squash(F.col("en_text")).alias("en"), R.squash(F.col("zh_text")).alias("zh"))
    near = neighbours(rows, ["video_id"], ["id", "start_ms", "end_ms", "en", "zh"], before=False)
    gap, span = F.greatest(F.col("next.start_ms") - F.col("end_ms"), F.lit(0)), F.greatest(F.col("next.end_ms") - F.col("start_ms"), F.lit(0))
    both = R.squash(F.concat_ws(" ", "en", "next.en"))
    fits = (short_tail(F.col("en"), F.col("next.en"), gap) == "content_tail") & (gap <= max_gap_ms) & (span <= max_group_ms) & (R.visible_length(both) <= max_chars)
    marked = near.withColumn("_fits", F.coalesce(fits & F.col("next.id").isNotNull(), F.lit(False)))
    marked = running_sums(marked, ["video_id"], {"_n": F.lit(1)})
    marked = running_last(marked, ["video_id"], F.when(~F.col("_fits"), F.col("_n")), "_stop")
    takes = F.col("_fits") & ((F.col("_n") - F.coalesce("_stop", F.lit(0))) % 2 == 1)
    marked = neighbours(marked.withColumn("_takes", takes).withColumnRenamed("next", "then"), ["video_id"], ["_takes"], after=False)
    kept = marked.where(~F.coalesce("prev._takes", F.lit(False)))
    join = lambda yes, no: F.when(F.col("_takes"), yes).otherwise(no)
    return kept.select(
        "video_id", F.col("id").alias("cue_id"), F.when(F.col("_takes"), F.col("then.id")).alias("tail_id"), "start_ms", join(F.col("then.end_ms"), F.col("end_ms")).alias("end_ms"),
        join(tidy_source_tail(F.concat_ws(" ", "en", "then.en")), F.col("en")).alias("en_text"), join(tidy_target_tail(F.concat("zh", "then.zh")), F.col("zh")).alias("zh_text"),
    )


def segmentation_metrics(segments: DataFrame, cues: DataFrame) -> DataFrame:
    """One row a video of counts: short fragments, mixed sentences and function edges among segments, kinds of tails, too short and too long among cues."""
    s = R.squash(F.col("source_text"))
    words = F.size(F.regexp_extract_all(s, F.lit("([A-Za-z0-9']+)"), 1))
    one = segments.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.count_if((s != "") & ~R.ends_sentence(s) & (words <= 5)).alias("n_short_fragment"), F.count_if(s.rlike("[a-z0-9][.!?] +[A-Z0-9]")).alias("n_mixed_sentence"),
        F.count_if(R.opens_with_continuation(s) | R.ends_with_open_word(s)).alias("n_function_edge"),
    )
    kinds = tail_kinds(cues).groupBy("video_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("content_tail", "standalone_particle", "ambiguous_particle")])
    span = F.col("end_ms") - F.col("start_ms")
    two = cues.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_cues"), F.count_if(span < 700).alias("n_too_short"), F.count_if(span > 6950).alias("n_too_long"))
    return one.join(two, "video_id").join(kinds, "video_id")
