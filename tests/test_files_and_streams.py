import json

import pytest
from pyspark.sql import functions as F

from reelspan.sinks import files as K
from reelspan.sources import files as S
from reelspan.streaming import log as L


def test_segments_from_documents(spark, tmp_path):
    seg = {"id": 1, "start": 0.5, "end": 1.5, "source_text": "a"}
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": 1, "segments": [seg]}))
    (tmp_path / "b.json").write_text(json.dumps([seg | {"source": "srt", "words": [{"word": "a", "start": 0.5, "end": 1.5}]}]))
    got = sorted((r.source, len(r.words)) for r in S.read_segments(spark, str(tmp_path)).collect())
    assert got == [("asr", 0), ("srt", 1)]
    (tmp_path / "c.json").write_text('{"nothing": 1}')
    with pytest.raises(Exception, match="no segments"):
        S.read_segments(spark, str(tmp_path)).collect()


def test_document_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("v", 2, 3.0, 4.0, "b"), ("v", 1, 1.0, 2.0, "a")], "video_id string, id long, start double, end double, source_text string")
    doc = K.segment_document(rows, "video_id").first().value
    (tmp_path / "v.json").write_text(doc)
    assert json.loads(doc)["segment_count"] == 2
    assert [(r.id, r.source_text) for r in S.read_segments(spark, str(tmp_path)).orderBy("pos").collect()] == [(1, "a"), (2, "b")]


def test_jsonl(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.LongType())])
    (tmp_path / "x.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert sorted(r.k for r in S.read_jsonl(spark, str(tmp_path / "x.jsonl"), schema).collect()) == [1, 2]
    (tmp_path / "y.jsonl").write_text('{"k": 1}\nnot json\n')
    assert [r.k for r in S.read_jsonl(spark, str(tmp_path / "y.jsonl"), schema, strict=False).collect()] == [1]
    with pytest.raises(Exception):  # noqa: B017
        S.read_jsonl(spark, str(tmp_path / "y.jsonl"), schema).collect()
    K.write_jsonl(spark.createDataFrame([(3,)], "k long"), str(tmp_path / "out"))
    K.write_jsonl(spark.createDataFrame([(4,)], "k long"), str(tmp_path / "out"), append=True)
    assert sorted(r.k for r in S.read_jsonl(spark, str(tmp_path / "out"), schema).collect()) == [3, 4]


def test_ass_and_srt(spark):
    lines = ["[Events]", r"Dialogue: 0,0:00:01.00,0:00:03.50,ZH ,,0,0,0,,{\i1}一，二\N三{\i0}", "Dialogue: 1,bad,0:00:03.00,EN,,0,0,0,,x", "Comment: 0"]
    got = S.parse_dialogues(spark.createDataFrame([(x,) for x in lines], "value string")).select("layer", "start_ms", "end_ms", "style", S.plain_text(F.col("text")).alias("t")).collect()
    assert [tuple(r) for r in got] == [(0, 1000, 3500, "ZH", "一，二\n三")]
    rows = spark.createDataFrame([("v", 1000, 2500, "one\ntwo"), ("v", 3000, 4000, "three"), ("v", None, 1, "lost"), ("v", 1, 2, " ")], "video_id string, start_ms long, end_ms long, text string")
    whole = "\n\n".join(r.block for r in K.srt_blocks(rows, "video_id", "text").orderBy("number").collect())
    back = S.parse_srt(spark.createDataFrame([(whole,)], "value string")).orderBy("number").collect()
    assert [(r.number, r.start_ms, r.end_ms, r.text) for r in back] == [(1, 1000, 2500, "one\ntwo"), (2, 3000, 4000, "three")]


def test_captions_and_glossary(spark):
    doc = json.dumps({"events": [{"tStartMs": 10, "dDurationMs": 0, "segs": [{"utf8": "a "}, {"utf8": "b"}]}, {"tStartMs": 20}, {"segs": [{"utf8": "\n"}]}]})
    assert [tuple(r) for r in S.parse_captions(spark.createDataFrame([(doc,)], "value string")).collect()] == [(10, 2010, "a b")]
    got = S.parse_glossary(spark.createDataFrame([("- Node.js | policy=preserve | zh=a=b",), ("# no",)], "value string")).first()
    assert (got.canonical, got.properties) == ("Node.js", {"policy": "preserve", "zh": "a=b"})


def test_tables_and_history(spark, tmp_path):
    K.write_tsv(spark.createDataFrame([(1, "a")], "x int, y string"), str(tmp_path / "t"), ["y", "z"])
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "t")).columns == ["y", "z"]
    rows = spark.range(10).withColumnRenamed("id", "t")
    assert sorted(r.t for r in K.write_bounded_history(rows, None, str(tmp_path / "h"), "t", 3).collect()) == [7, 8, 9]
    a, b = spark.createDataFrame([(None, ""), ("", None)], "x string, y string").select(K.fingerprint(F.col("x"), F.col("y")).alias("f")).collect()
    assert a.f != b.f and len(a.f) == 64


def events(spark, rows, path):
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)


def test_sequence_numbers_go_on_over_batches(spark, tmp_path):
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    for part in ([(1, "2024-01-01 00:00:02", 7, "a", 1.0, ""), (2, "2024-01-01 00:00:01", 7, "a", 1.0, "")], [(3, "2024-01-02 00:00:00", 7, "b", 2.0, ""), (4, "2024-01-02 00:00:00", 8, "b", 2.0, "")]):
        events(spark, part, src)
        stream = L.event_stream(spark, src, "*.parquet").withColumn("ts_us", F.unix_micros("ts")).drop("ts")
        out = L.run_available(L.sequenced(stream, "user_id", "ts_us", payload="event_id"), spark, ck)
    assert sorted((r.user_id, r.seq, r.event_id) for r in out.collect()) == [(7, 1, 2), (7, 2, 1), (7, 3, 3), (8, 1, 4)]


def test_latest_state_twice_is_once(spark):
    a = spark.createDataFrame([("j", 1, "x"), ("j", 2, "y")], "k string, t long, v string")
    once = L.latest_state(a, None, ["k"], "t")
    assert [tuple(r) for r in L.latest_state(a, once, ["k"], "t").collect()] == [("j", 2, "y")]


def test_claimable(spark):
    jobs = spark.createDataFrame([("a", "queued", 5, None), ("b", "running", 1, 10), ("c", "running", 2, 99), ("d", "paused", 0, None)], "job_id string, status string, created_ms long, lease_until_ms long")
    assert [r.job_id for r in L.claimable(jobs, 50).collect()] == ["b", "a"]
