"""Queries on event logs, run as streams over what is there, and on subtitle files as text; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan import tables as T
from reelspan.functions import rules as R
from reelspan.operators.sequences import islands, neighbours
from reelspan.runtime import read, shared_folder
from reelspan.sinks.files import ass_lines, bilingual_events, fingerprint, srt_blocks
from reelspan.sources.files import parse_dialogues, plain_text
from reelspan.streaming import log as L


def _checkpoint(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, from a stream in complete mode."""
    counts = L.windowed_counts(L.event_stream(spark, sf_dir))
    return L.run_available(counts, spark, _checkpoint(spark), mode="complete").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def stream_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered by user, from a stream with state."""
    events = L.event_stream(spark, sf_dir).withColumn("ts_us", F.unix_micros("ts")).drop("ts")
    return L.run_available(L.sequenced(events, "user_id", "ts_us", payload="event_id"), spark, _checkpoint(spark)).select("user_id", "seq", "event_id")


def latest_event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user and type."""
    events = read(spark, sf_dir, "events", "user_id", "event_type", "event_id", "ts").withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    return L.latest_state(events, None, ["user_id", "event_type"], "ts_us").select("user_id", "event_type", "event_id")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: events at most six hours apart."""
    events = read(spark, sf_dir, "events", "user_id", "event_id", "ts").select("user_id", F.col("event_id").alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("start_ms")).withColumn("end_ms", F.col("start_ms"))
    day = 86_400_000
    near = neighbours(events, ["user_id"], ["start_ms"], after=False, shard_ms=30 * day)
    new = F.coalesce(F.col("start_ms") - F.col("prev.start_ms") > 21_600_000, F.lit(True))
    marked = islands(near.withColumn("_new", new).drop("prev"), ["user_id"], F.col("_new"), "session", shard_ms=30 * day)
    return marked.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), (F.max("start_ms") - F.min("start_ms")).alias("span_ms"))


def ass_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues written as lines of a bilingual ASS file and read back."""
    events = bilingual_events(T.timed(T.cues(spark, sf_dir)))
    back = parse_dialogues(ass_lines(events.select("video_id", F.col("id").alias("cue_id"), "layer", "start_ms", "end_ms", "style", "text")).select("video_id", "cue_id", F.col("line").alias("value")))
    return back.select("video_id", "cue_id", "layer", F.col("start_ms").alias("start_10ms"), "style", R.squash(plain_text(F.col("text"))).alias("text"))


def srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues as numbered blocks of SRT files."""
    return srt_blocks(T.timed(T.cues(spark, sf_dir)), "video_id", "zh_text")


def project_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of what is known of each project."""
    meta = read(spark, sf_dir, "source_meta", "project_id", "video_id", "url", "title").distinct()
    return meta.select("project_id", "video_id", fingerprint(F.col("project_id"), F.col("video_id"), F.col("url"), F.col("title")).alias("fingerprint"))


def clip_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects by length of their video, in bands of a minute."""
    meta = read(spark, sf_dir, "source_meta", "project_id", "duration").distinct()
    return meta.groupBy(F.floor(F.col("duration") / 60).alias("minutes")).agg(F.count(F.lit(1)).alias("n_projects"))


QUERIES = {f.__name__: f for f in (stream_daily_counts, stream_sequences, latest_event_state, user_sessions, ass_round_trip, srt_files, project_fingerprints, clip_lengths)}

SQL = {
    "stream_daily_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS value_milli FROM events GROUP BY 1, 2",
    "stream_sequences": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id FROM events",
    "latest_event_state": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "user_sessions": "WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 21600000 THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, max(t) - min(t) AS span_ms FROM s GROUP BY 1, 2",
    "ass_round_trip": f"""WITH {T.CUES_SQL}, t AS (SELECT * FROM cue WHERE end_ms > start_ms),
e AS (SELECT video_id, cue_id, 0 AS layer, start_ms, 'ZH' AS style, zh_text AS text FROM t WHERE regexp_matches(zh_text, '[\\x{{3400}}-\\x{{9fff}}]') UNION ALL SELECT video_id, cue_id, 1, start_ms, 'EN', en_text FROM t WHERE trim(en_text) <> '')
SELECT video_id, cue_id, layer, (start_ms + 5) // 10 * 10 AS start_10ms, style, trim(regexp_replace(translate(text, '{{}}', '()'), '[\\s\\pZ]+', ' ', 'g')) AS text FROM e""",
    "srt_files": f"""WITH {T.CUES_SQL}, t AS (SELECT video_id, trim(zh_text, ' ') AS z, zh_text, start_ms, end_ms, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, zh_text) AS number FROM cue WHERE end_ms > start_ms AND trim(zh_text, ' ') <> '')
SELECT video_id, number, number || chr(10) || printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) || chr(10) || z AS block FROM t""",
    "project_fingerprints": """SELECT DISTINCT project_id, video_id, sha256('{"p000":' || to_json(project_id) || ',"p001":' || to_json(video_id) || ',"p002":' || to_json(url) || ',"p003":' || to_json(title) || '}') AS fingerprint FROM source_meta""",
    "clip_lengths": "SELECT CAST(floor(duration / 60) AS BIGINT) AS minutes, count(*) AS n_projects FROM (SELECT DISTINCT project_id, duration FROM source_meta) GROUP BY 1",
}
