from pyspark.sql import functions as F

from reelspan.functions import rules as R
from reelspan.functions.text import fold, millis
from reelspan.operators import dictionary as D
from reelspan.operators import feedback as B
from reelspan.operators import quality as Q


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_folding_and_times(spark):
    assert one(spark, fold, " a　\n b ") == "a b"
    assert one(spark, fold, None) is None
    assert one(spark, millis, 1.2345, "double") == 1235
    assert one(spark, millis, float("nan"), "double") is None
    assert one(spark, R.parse_clock, "1:02:03.45") == 3_723_450
    assert one(spark, R.parse_clock, "00:00:01,500") == 1500
    assert one(spark, R.parse_clock, "soon") is None
    assert one(spark, R.ass_time, 3_723_456, "long") == "1:02:03.46"
    assert one(spark, R.srt_time, 3_723_456, "long") == "01:02:03,456"


def test_multiset_similarity(spark):
    got = spark.createDataFrame([("abca", "aabd"), ("", ""), ("a", None), ("中中", "中")], "a string, b string").select(R.multiset_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == [0.75, 1.0, 0.0, 0.5]


def test_edge_words_and_risk(spark):
    df = spark.createDataFrame([("and then the", "然后的", 0, 1000), ("It costs 20 dollars today.", "今天二十美元。", 0, 100), (None, None, None, None)], "s string, t string, a long, b long")
    codes = [[c.code for c in r.x] for r in df.select(Q.risk_codes(F.col("s"), F.col("t"), F.col("a"), F.col("b")).alias("x")).collect()]
    assert codes[0] == ["source_starts_with_continuation", "source_open_clause", "source_ends_with_open_word", "target_open_ending", "target_too_short"]
    assert codes[1] == ["number_mismatch", "target_cps_very_high"]
    assert codes[2] == []


def test_source_spans_of_a_split_sentence(spark):
    rows = [("v", 1, 0, 1900, "He told me just before leaving, and", ""), ("v", 2, 2000, 3900, "and the next day the police", ""), ("v", 3, 4000, 5000, "knocked on his door.", "")]
    spans = Q.source_spans(spark.createDataFrame(rows, "video_id string, id long, start_ms long, end_ms long, source_text string, target_text string")).collect()
    assert [(s.start_id, s.end_id, s.n_segments, s.strategy) for s in spans] == [(1, 3, 3, "span_first")]


def test_chains_are_cut(spark):
    rows = [("v", k, 1000 * k, 1000 * k + 900, "more and more words", "") for k in range(20)]
    spans = Q.source_spans(spark.createDataFrame(rows, "video_id string, id long, start_ms long, end_ms long, source_text string, target_text string")).orderBy("start_ms").collect()
    assert [s.n_segments for s in spans] == [8, 8, 4]


def test_term_hits_and_corrections(spark):
    texts = spark.createDataFrame([(1, "The Node.js-server and C++ (node.js)"), (2, "nodes"), (3, None), (4, "Eectric antenna, EECTRIC ANTENNA!")], "id long, text string")
    terms = spark.createDataFrame([(7, "Node.js"), (8, None), (9, "Eectric Antenna")], "term_id long, term string")
    assert sorted((r.id, r.term_id) for r in D.term_hits(texts, terms, ["id"], "text", "term").collect()) == [(1, 7), (4, 9)]
    rules = spark.createDataFrame([("Eectric Antenna", "Electric $Antenna"), ("antenna", "x")], "form string, replacement string")
    got = {r.id: r.after for r in D.corrected(texts, rules.where("form <> 'antenna'"), ["id"], "text").collect()}
    assert got == {4: "Electric $Antenna, Electric $Antenna!"}


def test_consistency(spark):
    segs = spark.createDataFrame([("v", 1, "The Marble Mirror fell.", "大理石镜子掉了。"), ("v", 2, "Marble Mirror", "Marble Mirror"), ("v", 3, "Silent Garden", "Silent Garden")], "video_id string, id long, source_text string, target_text string")
    terms = spark.createDataFrame([(1, "Marble Mirror", ["Marbel Mirror"], "Marble Mirror", "preserve"), (2, "Silent Garden", [], "《寂静花园》", "translate")], "term_id long, canonical string, bad_aliases array<string>, zh string, policy string")
    assert sorted((r.id, r.issue) for r in D.consistency(segs, terms).collect()) == [(1, "term_not_preserved"), (3, "term_not_translated")]


def test_records(spark):
    df = spark.createDataFrame([("a", "x", "m1", "h1"), ("a", "x", "m1", "h1"), ("a", "y", "m2", "h2"), ("a", "y", "m2", "h3"), ("a", "z", "m4", "h4"), ("a", "z", "m5", "h4"), ("a", None, None, None)], "p string, s string, m string, h string")
    got = {(r.kind, r.source): (r.n_records, r.n_variants) for r in B.same_and_different(df, F.col("s"), F.col("m"), F.col("h")).collect()}
    assert got == {("duplicate", "x"): (2, 1), ("conflict", "y"): (2, 2), ("merge", "z"): (2, 2)}
    old, new = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k long, v string")
    assert sorted(map(tuple, B.append_new(old, new, F.col("k"), F.ascii("v")).collect())) == [(2, "c")]
    assert sorted(map(tuple, B.upsert(old, new, F.col("k"), F.ascii("v")).collect())) == [(1, "b"), (2, "d")]


def test_ranking_quality(spark):
    ranked = spark.createDataFrame([(1, 1, True), (2, 1, False), (2, 2, True), (3, 1, False)], "query_id long, rank int, same_project boolean")
    r = B.ranking_quality(ranked).first()
    assert (r.n_queries, r.recall_1_ppm, r.recall_3_ppm, r.mrr_ppm) == (3, 333_333, 666_666, 500_000)


def test_terms_of_more_than_a_hundred_lengths(spark):
    said = [f"w{k}" for k in range(102)]
    terms = spark.createDataFrame([(n, " ".join(said[:n])) for n in range(1, 103)], "term_id int, form string")
    texts = spark.createDataFrame([(1, " ".join(said))], "id int, text string")
    assert sorted(r.term_id for r in D.term_hits(texts, terms, ["id"], "text", "form").collect()) == list(range(1, 103))
