import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelspan.functions import wording as W
from reelspan.functions import wrapping as L
from reelspan.operators import allocation as A
from reelspan.operators import clusters as C
from reelspan.operators import quality as Q
from reelspan.operators import records as E
from reelspan.operators import review as V
from reelspan.operators import tails as O
from reelspan.operators import terminology as G
from reelspan.operators.sequences import running_max
from reelspan.streaming import jobs as J

SEG = "video_id string, id long, start_ms long, end_ms long, source_text string, target_text string"
TERM = "term_id long, canonical string, zh string, policy string, priority string, short_name string, aliases array<string>, bad_aliases array<string>"


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r.y for r in rows.select("k", make(F.col("x")).alias("y")).orderBy("k").collect()]


def test_measures_of_wording(spark):
    assert column(spark, ["i went", "Tape", "one two three.", "привет", "Lona Repita", None, "that"], W.translatable) == [True, False, True, True, False, False, True]
    assert column(spark, ["Mr. Bell came. He sat. ", "e.g. this one", None, ""], W.sentence_count) == [2, 1, 0, 0]
    assert column(spark, ["他来了。她走了，3.5米", "C:/a.b：好", None], W.meaning_chunks) == [["他来了。", "她走了，", "3.5米"], ["C:/a.b：", "好"], []]
    assert column(spark, ["用theme.conf改", None], W.mixed_tokens) == [["用", "theme.conf", "改"], []]
    assert column(spark, ["The Lona Repita's", "  «Node.js.» ", None], W.pure_term) == ["lonarepita", "nodejs", ""]
    assert column(spark, ["and i said i'm in", None], W.first_person) == ["and I said I'm in", None]
    assert column(spark, ["ru-RU", "EN_us", None, "fr"], W.language_code) == ["ru", "en", "en", "fr"]
    assert column(spark, ["ＡＢＣ ß", None], W.compatible_key) == ["abc ss", ""]


def test_titles_and_addresses(spark):
    assert column(spark, ["The Silent Garden [HD] Ep. 3 - part 2!", None], W.clean_title) == ["The Silent Garden -", ""]
    assert column(spark, ["The Silent Garden, the silent garden by Lona Repita. YouTube", None], W.proper_phrases) == [["The Silent Garden", "Lona Repita"], []]
    assert column(spark, ["<p>a &amp; b<script>x()</script></p>", None], W.strip_markup) == ["a & b", ""]
    assert column(spark, ["https://x.example/watch?v=abc_12-XY&t=3", "https://youtu.be/abcdef1", "none", None], W.video_key) == ["abc_12-XY", "abcdef1", "", ""]
    assert column(spark, ["  A b/ç d! ", None], W.slug) == ["A-b-d", ""]
    assert column(spark, ["a.MP4", "x.ass", "qa_rows.tsv", "entity_metrics.json", "manifest.json", "translated_segments.json", "z"], W.artifact_kind) == ["video", "ass", "qa", "entity_metrics", "manifest", "segments", "artifact"]
    assert column(spark, ["#fa0", "00ff7f", "red", None], W.hex_color) == ["#FFAA00", "#00FF7F", "#FFFFFF", "#FFFFFF"]
    assert column(spark, ["#112233"], lambda c: W.ass_color(c, F.lit("50"))) == ["&H80332211"]
    assert column(spark, ["7", "x", None, "999"], lambda c: W.clamp(c, 0, 100, 5)) == [7.0, 5.0, 5.0, 100.0]
    assert column(spark, ['```json\n[{"id": 1}]\n```', "no"], lambda c: W.fenced_json(c, "array<struct<id:int>>")) == [[(1,)], None]


def test_short_tails(spark):
    pairs = [("knocked on the", "door.", 0), ("He left.", "Yeah.", 300), ("He left.", "Yeah.", 100), ("Will you?", "Sure.", 0), ("He left.", "Right.", 0), ("He left.", "quickly.", 0), ("He left.", "A whole new sentence.", 0), (None, "Door.", None)]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string, gap long")
    got = [r.y for r in rows.select("k", W.short_tail(F.col("a"), F.col("b"), F.col("gap")).alias("y")).orderBy("k").collect()]
    assert got == ["content_tail", "standalone_particle", "ambiguous_particle", "standalone_particle", "ambiguous_particle", "content_tail", "not_terminal_short", "not_terminal_short"]


def test_tails_are_joined_in_pairs(spark):
    texts = ["knocked on the", "old", "door.", "He left.", "Yeah.", None]
    rows = [("v", k, 1000 * k, 1000 * k + 900, t, f"字{k}。", "clash") for k, t in enumerate(texts)] + [("v", 9, None, 5, "x", "y", "")]
    cues = spark.createDataFrame(rows, "video_id string, cue_id long, start_ms long, end_ms long, en_text string, zh_text string, next string").where("start_ms IS NOT NULL").drop("next")
    got = [(r.cue_id, r.tail_id, r.en_text, r.end_ms) for r in O.join_tails(cues).orderBy("cue_id").collect()]
    assert got == [(0, None, "knocked on the", 900), (1, 2, "old door.", 2900), (3, None, "He left.", 3900), (4, None, "Yeah.", 4900), (5, None, "", 5900)]
    assert O.join_tails(cues.limit(0)).count() == 0
    assert column(spark, ["他走了。门。", "他走了。走了。", None], O.tidy_target_tail) == ["他走了门。", "他走了走了。", ""]


def test_terms_of_the_glossary(spark):
    terms = [
        (1, "Juan Kokom", "胡安", "preserve", None, None, None, None), (2, "Node.js", "Node.js", "preserve", "hard", None, None, None), (3, "Silent Garden", "寂静花园", "mixed", None, "花园", ["The Garden"], ["Silent Gardn"]),
        (4, "Metro", "地铁", "translate", None, None, None, [None, " Metroo "]), (5, None, "x", "translate", None, None, None, None),
    ]
    glossary = spark.createDataFrame(terms, TERM)
    segs = [("Juan Kokom.", "x"), ("Node.js.", "x"), ("The Silent Garden", "x"), ("silent gardn!", "x"), ("Metro", "x"), (None, "坐Metro去Metroo。"), ("The Silent Gardn opens.", None), ("", "")]
    df = spark.createDataFrame([("v", k, 1000 * k, 1000 * k + 900, s, t) for k, (s, t) in enumerate(segs)], SEG)
    locks = {r.id: (r.term_id, r.first_mention, r.target) for r in G.lock_terms(df, glossary).collect()}
    assert locks == {1: (2, True, "Node.js"), 2: (3, True, "寂静花园（Silent Garden）"), 3: (3, False, "花园"), 4: (4, True, "地铁")}
    assert [(r.id, r.after) for r in G.translate_left_terms(df, glossary).collect()] == [(5, "坐地铁去地铁。")]
    words = "array<struct<word string, start_s double, end_s double, confidence double>>"
    timed = df.withColumn("words", F.when(F.col("id") == 6, F.transform(F.split("source_text", " "), lambda w, k: F.struct(w.alias("word"), k.cast("double").alias("start_s"), (k + 1).cast("double").alias("end_s"), F.lit(1.0).alias("confidence")))).cast(words))
    fixed = {r.id: (r.after, [w.word for w in r.words or []]) for r in G.repair_sources(timed, glossary).collect()}
    assert fixed == {3: ("Silent Garden!", []), 6: ("The Silent Garden opens.", ["The", "Silent", "Garden", "opens."])}
    assert [(r.id, r.canonical) for r in G.preserved_only(df, glossary, ["id"], "source_text").orderBy("id").collect()] == [(0, "Juan Kokom"), (1, "Node.js")]
    assert G.lock_terms(df.limit(0), glossary).count() == G.lock_terms(df, glossary.limit(0)).count() == 0


def test_allocation_of_a_span(spark):
    segs = spark.createDataFrame([("v", 1, 0, 1000, "The city sleeps.", "城市睡着了。"), ("v", 2, 1100, 2000, "He wonders.", "城市睡着了。"), ("v", 3, 2100, 4000, "While translation isn't exciting", "的"), ("v", 4, 5000, 6000, None, None)], SEG)
    spans = spark.createDataFrame([("v", "a", [1, 2, 3], 3, 9, 1)], "video_id string, span string, segment_ids array<long>, n_segments long, risk_score long, start_id long")
    got = {r.id: (r.flags, r.status) for r in A.allocation(segs, spans).collect()}
    assert got == {1: ([], "applied"), 2: (["adjacent_duplicate_target"], "applied"), 3: (["target_open_ending", "target_too_short"], "review"), 4: (["empty_target"], "review")}


def test_translation_issues(spark):
    asked = spark.createDataFrame([(1, "They left the city."), (2, "They left."), (3, "They left the city."), (4, "Lona"), (5, "They came back again.")], "id long, source string")
    given = spark.createDataFrame([(1, "they left the city"), (3, " "), (4, "Lona"), (5, "他们well回来了Ж。"), (9, "多余")], "id long, target string")
    got = sorted((r.id, r.issue) for r in A.translation_issues(asked, given, ["id"]).collect())
    assert got == [(1, "source_echo"), (1, "target_without_chinese"), (2, "missing"), (3, "empty"), (5, "short_english_leak"), (5, "text_pollution"), (9, "extra")]


def test_repair_gain_and_gate(spark):
    rows = spark.createDataFrame([("They left on the 20 of May, and", "他们和", "他们五月20日离开了。")], "s string, a string, b string")
    codes = lambda c: Q.risk_codes(F.col("s"), F.col(c), F.lit(0), F.lit(4000))
    assert rows.select(A.repair_gain(codes("a"), codes("b"))).first()[0] == 8
    counts = F.create_map(F.lit("target_too_short"), F.lit(1), F.lit("target_open_ending"), F.lit(1))
    assert rows.select(A.blocking_span(counts, F.lit("high"))).first()[0] and not rows.select(A.blocking_span(counts, F.lit("low"))).first()[0]


def test_running_max_over_shards(spark):
    rows = [("v", k, s, e) for k, (s, e) in enumerate([(0, 5_000_000), (100, 200), (700_000, 800_000), (2_000_000, 2_100_000)])]
    df = spark.createDataFrame(rows, "video_id string, id long, start_ms long, end_ms long")
    assert [r.m for r in running_max(df, ["video_id"], F.col("end_ms"), "m").orderBy("id").collect()] == [None, 5_000_000, 5_000_000, 5_000_000]


def test_clusters_are_cut(spark):
    spans = spark.createDataFrame([("v", str(k), 3 * k, 3 * k + 1, 1) for k in range(20)] + [("v", "far", 900, 901, 5)], "video_id string, span string, start_id long, end_id long, score long")
    got = sorted((r.first_id, r.last_id, r.n_spans) for r in C.repair_clusters(spans).collect())
    assert got == [(0, 22, 8), (24, 46, 8), (48, 58, 4), (900, 901, 1)]


RECORD = "example_id long, project_id string, span_id string, segment_ids array<long>, start_s double, end_s double, source_joined string, risk_reasons map<string,int>, translation_strategy string, machine_target_by_id map<string,string>, manual_target_by_id map<string,string>, accepted boolean, use_for_span_prompt boolean, created_at timestamp, risk_score int"


def test_rules_of_records(spark):
    import datetime

    at = datetime.datetime(2025, 1, 1)
    good = (1, "p", "s1", [1, 2], 0.0, 1.0, "x", {}, "normal", {"1": "a"}, {"2": "b"}, True, False, at, 3)
    rows = [good, (2, " ", None, [], 2.0, 1.0, "x", None, "normal", {"9": "a"}, {}, False, True, at, 3), (3, "p", "s1", [1], 0.0, 1.0, "x", {}, "normal", {}, {}, True, None, at, 30)]
    df = spark.createDataFrame(rows, RECORD)
    got = sorted((r.example_id, r.rule) for r in E.violations(df).collect())
    assert got == sorted([(2, x) for x in ("empty_segment_ids", "end_not_after_start", "machine_target_of_other_segment", "missing_project_id", "missing_risk_reasons", "missing_span_id", "used_before_accepted")] + [(3, "missing_use_for_span_prompt")])
    key = F.concat_ws("|", "project_id", "span_id")
    assert [r.example_id for r in E.gold_records(df, key).collect()] == [1]
    assert tuple(E.validation(df, key).first()) == (3, 2, 1, 2)
    done = {r.example_id: (r.accepted, r.use_for_span_prompt, r.updated) for r in E.bulk_updates(df, F.col("risk_score") < 10, "reject", F.col("example_id"), 5).collect()}
    assert done == {1: (False, False, True), 2: (False, False, True), 3: (True, False, False)}
    assert len(E.evaluation_sample(df, F.col("accepted"), F.col("example_id"), 2).collect()) == 2


def test_first_per_key_of_a_hot_key(spark):
    rows = spark.createDataFrame([("hot" if k % 3 else "cold", k) for k in range(3000)], "k string, v long")
    got = sorted((r.k, r.v, r.place) for r in E.first_per_key(rows, ["k"], [F.desc("v")], 3).collect())
    assert got == [("cold", 2991, 3), ("cold", 2994, 2), ("cold", 2997, 1), ("hot", 2996, 3), ("hot", 2998, 2), ("hot", 2999, 1)]


def test_jobs(spark):
    updates = spark.createDataFrame([("j", 1, "queued", None, None), ("j", 2, "running", 150, None), ("j", 3, None, None, 77), ("j", 4, None, -5, 99)], "job_id string, at long, status string, progress int, completed_at long")
    assert tuple(J.current_jobs(updates, ["job_id"], ["at"]).first()) == ("j", "running", 0, 77, 4)
    jobs = spark.createDataFrame([("a", "running", 5, 100), ("b", "queued", 7, None), ("c", "running", 1, 900)], "job_id string, status string, created_ms long, lease_until_ms long")
    first = J.claim(jobs, 500, lease_ms=60, worker=F.lit(9)).first()
    assert (first.job_id, first.status, first.lease_until_ms, first.worker) == ("a", "running", 560, 9)
    beats = spark.createDataFrame([("a", 50), ("a", 490), ("c", 10)], "job_id string, at_ms long")
    got = {r.job_id: r.lease_until_ms for r in J.with_heartbeats(jobs, beats, lease_ms=10, least_ms=30).collect()}
    assert got == {"a": 520, "b": None, "c": 900}
    tail = J.event_tail(spark.createDataFrame([("u", k) for k in range(9)], "u string, e long"), ["u"], ["e"], 3).orderBy("seq").collect()
    assert [(r.seq, r.e) for r in tail] == [(1, 6), (2, 7), (3, 8)]


def test_review_rows(spark):
    feed = lambda rows: spark.createDataFrame(rows, "video_id string, id long, risk_type string, severity string, score int")
    got = sorted(tuple(r) for r in V.editor_rows([feed([("v", 1, "a", "low", 2)]), feed([("v", 1, "a", "high", 9), ("v", 1, "b", "high", 9), ("v", 1, "b", "low", 1)])]).collect())
    assert got == [("v", 1, "a", "low", 2, 1), ("v", 1, "b", "high", 9, 2)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="城市睡着了，。 ab1.", max_size=120), st.integers(1, 4))
def test_chinese_parts_keep_the_text(text, parts):
    made = L.chinese_parts(text, parts)
    assert len(made) <= parts and "".join("".join(made).split()) == "".join(text.split())
    assert all(made) and "".join("".join(L.wrap_chinese_text(text, 10, 3)).split()) == "".join(text.split())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcé,.", min_size=1, max_size=9), max_size=40), st.integers(5, 40), st.integers(1, 4))
def test_word_parts_keep_words(words, chars, parts):
    made = L.word_parts(" ".join(words), chars, parts)
    assert len(made) <= parts and " ".join(made) == " ".join(words)


def test_wrapping(spark):
    assert L.wrap_chinese_text("录音师在旧录音棚里烧掉了隐藏曲目，电台主持人卖掉了一张空封套。") == "录音师在旧录音棚里烧掉了隐藏曲目，\n电台主持人卖掉了一张空封套。"
    assert L.wrap_chinese_text(None) == "" and L.word_parts(None, 5, 2) == [] and len(L.wrap_chinese_text("字" * 5000, 28, 2).split("\n")) == 2
    assert column(spark, ["old tape", None], lambda c: L.split_words(c, 4, 3)) == [["old", "tape"], []]


@pytest.mark.parametrize("master", ["spark://h:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    from reelspan import runtime

    class Nothing:
        def isDefined(self):
            return False

    class Context:
        applicationId = "x"
        master = ""
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Nothing()})()})()

        def getConf(self):
            return {}

    runtime._shipped.add("x")
    session = type("Session", (), {"sparkContext": Context()})()
    session.sparkContext.master = master
    with pytest.raises(RuntimeError):
        runtime.shared_folder(session)
