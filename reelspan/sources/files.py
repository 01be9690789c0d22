"""Readers of the formats that timed text comes in; schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspan.functions import rules as R

WORD = T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("confidence", T.DoubleType())])
SEGMENT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("source_text", T.StringType()), T.StructField("target_text", T.StringType()),
    T.StructField("reference_text", T.StringType()), T.StructField("words", T.ArrayType(WORD)), T.StructField("confidence", T.DoubleType()), T.StructField("source", T.StringType()),
])


def read_segments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Segments of JSON documents, an envelope with ``segments`` or a bare array: ``path`` and the fields of a segment, ``source`` 'asr' if missing.

    A document that is neither, or no JSON, fails the job. Documents are read whole, one a task at least.
    """
    texts = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.trim("value").alias("value"))
    arrays = T.ArrayType(SEGMENT)
    inner = F.when(F.col("value").startswith("["), F.from_json("value", arrays, {"mode": "FAILFAST"})).otherwise(F.from_json("value", T.StructType([T.StructField("segments", arrays)]), {"mode": "FAILFAST"})["segments"])
    checked = F.when(inner.isNull(), F.raise_error(F.concat(F.lit("no segments in "), F.col("path")))).otherwise(inner)
    rows = texts.select("path", F.posexplode(checked).alias("_pos", "s")).select("path", F.col("_pos").alias("pos"), "s.*")
    return rows.withColumn("source", F.coalesce("source", F.lit("asr"))).withColumn("words", F.coalesce("words", F.array().cast(T.ArrayType(WORD))))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, *, strict: bool = True) -> DataFrame:
    """Records of a JSONL file. Strict: a line that is no object of the schema fails the job; else such lines are left out. Blank lines don't count."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.json(path)


def parse_dialogues(lines: DataFrame, line: str = "value") -> DataFrame:
    """Events of ASS lines: the columns of ``lines`` with ``layer, start_ms, end_ms, style, text``; other lines and bad times are left out. Commas in the text stay."""
    parts = F.split(F.regexp_replace(F.col(line), r"^Dialogue:\s*", ""), ",", 10)
    rows = lines.where(F.col(line).startswith("Dialogue:")).withColumn("_p", parts).where(F.size("_p") == 10)
    rows = rows.select(*lines.columns, F.col("_p")[0].try_cast("int").alias("layer"), R.parse_clock(F.col("_p")[1]).alias("start_ms"), R.parse_clock(F.col("_p")[2]).alias("end_ms"), F.trim(F.col("_p")[3]).alias("style"), F.col("_p")[9].alias("text"))
    return rows.where("layer IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL")


def plain_text(text: Column) -> Column:
    """An event's text without override tags, its breaks as new lines."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\{[^}]*\}", ""), r"\\[Nn]", "\n"))


def read_ass(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events of ASS files with their ``path``."""
    return parse_dialogues(spark.read.text(paths).select(F.input_file_name().alias("path"), "value")).drop("value")


def parse_srt(documents: DataFrame, text: str = "value") -> DataFrame:
    """Cues of whole SRT documents: the other columns with ``number, start_ms, end_ms, text``; blocks without a time line are left out."""
    blocks = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"\n[ \t]*\n")
    rows = documents.select(*[c for c in documents.columns if c != text], F.explode(blocks).alias("_b"))
    found = lambda k: F.regexp_extract("_b", r"(?s)^\s*(\d+)[ \t]*\n\s*([\d:,.]+)\s*-->\s*([\d:,.]+)[^\n]*\n?(.*)$", k)
    rows = rows.select(*[c for c in rows.columns if c != "_b"], found(1).try_cast("bigint").alias("number"), R.parse_clock(found(2)).alias("start_ms"), R.parse_clock(found(3)).alias("end_ms"), F.trim(found(4)).alias("text"))
    return rows.where("number IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL")


CAPTIONS = T.StructType([T.StructField("events", T.ArrayType(T.StructType([
    T.StructField("tStartMs", T.LongType()), T.StructField("dDurationMs", T.LongType()), T.StructField("segs", T.ArrayType(T.StructType([T.StructField("utf8", T.StringType())]))),
])))])


def parse_captions(documents: DataFrame, text: str = "value") -> DataFrame:
    """Captions of JSON3 documents: the other columns with ``start_ms, end_ms, text``; a duration that isn't positive is 2 s, empty captions are left out."""
    keep = [c for c in documents.columns if c != text]
    rows = documents.select(*keep, F.explode(F.from_json(F.col(text), CAPTIONS)["events"]).alias("e"))
    said = R.squash(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s.utf8, F.lit(""))), ""))
    start, last = F.coalesce("e.tStartMs", F.lit(0)), F.coalesce("e.dDurationMs", F.lit(0))
    return rows.select(*keep, start.alias("start_ms"), (start + F.when(last > 0, last).otherwise(2000)).alias("end_ms"), said.alias("text")).where("text <> ''")


def parse_glossary(lines: DataFrame, line: str = "value") -> DataFrame:
    """Terms of a text glossary, ``- canonical | key=value | …``: ``canonical`` and ``properties``, a map."""
    rows = lines.where(F.trim(line).startswith("- ")).withColumn("_p", F.transform(F.split(F.regexp_replace(F.trim(line), r"^-\s+", ""), r"\|"), lambda x: F.trim(x)))
    pairs = F.filter(F.slice("_p", 2, F.size("_p")), lambda x: x.contains("="))
    properties = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.lower(F.trim(F.split(x, "=", 2)[0])), F.trim(F.split(x, "=", 2)[1]))))
    return rows.select(F.col("_p")[0].alias("canonical"), properties.alias("properties")).where("canonical <> ''")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, length, modified`` of the files under a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
