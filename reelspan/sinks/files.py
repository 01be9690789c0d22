"""Subtitle text as rows, and writers of documents, records and tables.

Spark's commit protocol publishes a folder only when it is whole, so a lost executor leaves nothing half written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions import rules as R
from reelspan.operators.sequences import renumber


def escape_ass(text: Column) -> Column:
    """Braces as brackets, line breaks as marks."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "{}", "()"), "\r?\n", r"\\N")


def ass_lines(events: DataFrame) -> DataFrame:
    """``events`` (``layer, start_ms, end_ms, style, text``) with ``line``: the event as a line of an ASS file."""
    line = F.concat(F.lit("Dialogue: "), F.col("layer").cast("string"), F.lit(","), R.ass_time(F.col("start_ms")), F.lit(","), R.ass_time(F.col("end_ms")), F.lit(","), F.trim("style"), F.lit(",,0,0,0,,"), escape_ass(F.col("text")))
    return events.withColumn("line", line)


def bilingual_events(cues: DataFrame) -> DataFrame:
    """Cues as events of two layers: 0 for the Chinese line if it has any signs, 1 for the reference line."""
    zh = cues.where(R.has_chinese(F.col("zh_text"))).select("video_id", F.col("cue_id").alias("id"), F.lit(0).alias("layer"), "start_ms", "end_ms", F.lit("ZH").alias("style"), F.trim("zh_text").alias("text"))
    en = cues.where(F.trim("en_text") != "").select("video_id", F.col("cue_id").alias("id"), F.lit(1).alias("layer"), "start_ms", "end_ms", F.lit("EN").alias("style"), F.trim("en_text").alias("text"))
    return zh.unionByName(en)


def srt_blocks(rows: DataFrame, entity: str, text: str) -> DataFrame:
    """``entity, number, block``: each row as a numbered block of its entity's SRT file, in order of time. Rows without text or times are left out."""
    said = rows.where((F.trim(text) != "") & F.col("start_ms").isNotNull() & (F.col("end_ms") > F.col("start_ms")))
    said = renumber(said, [entity], "number", order=("start_ms", "end_ms", text))
    block = F.concat(F.col("number").cast("string"), F.lit("\n"), R.srt_time(F.col("start_ms")), F.lit(" --> "), R.srt_time(F.col("end_ms")), F.lit("\n"), F.trim(text))
    return said.select(entity, "number", block.alias("block"))


def write_text(rows: DataFrame, path: str, entity: str, order: list[str], line: str) -> None:
    """A folder with a part for each entity, its lines in order."""
    rows.repartition(entity).sortWithinPartitions(entity, *order).select(entity, F.col(line).alias("value")).write.partitionBy(entity).mode("overwrite").text(path)


def segment_document(segments: DataFrame, entity: str) -> DataFrame:
    """``entity, value``: each entity's segments in an envelope with their number, as JSON."""
    row = F.struct(*[c for c in segments.columns if c != entity])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("start"), F.col("id"), row.alias("row")))), lambda x: x.row)
    return segments.groupBy(entity).agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.count(F.lit(1)).alias("segment_count"), ordered.alias("segments"))).alias("value"))


def write_jsonl(records: DataFrame, path: str, *, append: bool = False) -> None:
    records.write.mode("append" if append else "overwrite").json(path)


def write_tsv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Only the named columns, with a header; fields that the rows lack are empty."""
    out = rows.select(*[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in columns])
    out.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def write_bounded_history(rows: DataFrame, existing: DataFrame | None, path: str, order: str, most: int) -> DataFrame:
    """The newest ``most`` rows of both, written over ``path``; returns them. The bound is the feature."""
    every = rows if existing is None else existing.unionByName(rows)
    kept = every.orderBy(F.desc(order)).limit(most)
    kept.write.mode("overwrite").parquet(path)
    return kept


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of parts as JSON, nulls kept apart from empty texts."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{k:03d}") for k, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)
