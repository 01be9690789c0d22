import itertools

import pytest

from reelspan.operators import segmentation as S

W = "array<struct<word string, start_s double, end_s double, confidence double>>"
SEG = f"video_id string, id long, start_ms long, end_ms long, source_text string, words {W}"


def seg(k, text, *times):
    words = [(w, float(a), float(b), 1.0) for w, (a, b) in zip(text.split(), times, strict=True)] if times else None
    return ("v", k, round((times[0][0] if times else k) * 1000), round((times[-1][1] if times else k + 1) * 1000), text, words)


def refined(spark, rows):
    return [(r.source_ids, r.start_ms, r.end_ms, r.text) for r in S.refine_timing(spark.createDataFrame(rows, SEG)).orderBy("seq").collect()]


def test_split_at_a_sentence(spark):
    row = seg(1, "It is late. The city sleeps.", (0, 0.1), (0.1, 0.2), (0.2, 0.6), (0.9, 1.0), (1.0, 1.25), (1.25, 1.7))
    assert refined(spark, [row]) == [([1], 0, 600, "It is late."), ([1], 900, 1700, "The city sleeps.")]


def test_merge_of_an_open_fragment(spark):
    a = seg(1, "The silence is only broken by the mechanical", *[(3.22 + 0.27 * k, 3.48 + 0.27 * k) for k in range(8)])
    b = seg(2, "clicking of an old typewriter.", *[(5.48 + 0.37 * k, 5.84 + 0.37 * k) for k in range(5)])
    got = refined(spark, [a, b])
    assert [(g[0], g[3]) for g in got] == [([1, 2], "The silence is only broken by the mechanical clicking of an old typewriter.")]


def test_text_is_kept_and_ids_run(spark):
    long = seg(3, " ".join(f"word{k}," for k in range(60)), *[(20 + 0.3 * k, 20.25 + 0.3 * k) for k in range(60)])
    rows = [seg(1, "No words here at all."), long, ("v", 4, None, None, "lost", None), ("v", 5, 50_000, 51_000, None, None)]
    got = refined(spark, rows)
    assert " ".join(g[3] for g in got) == f"No words here at all. {long[4]}"
    assert all(g[2] - g[1] <= 2 * 6500 and len(g[3]) <= 2 * 84 for g in got)
    assert refined(spark, []) == []


def test_grouping_is_optimal():
    rules = S.SubtitleRules(line_chars=10, max_ms=2000)
    words = [(w, 300 * k, 300 * k + 250) for k, w in enumerate("the old radio tower, was empty. nobody had been there for".split())]
    best = S.group_words(words, rules)

    def cost(cuts):
        total, places = 0.0, [0, *cuts, len(words)]
        for a, b in itertools.pairwise(places):
            one = words[a:b]
            total += S.group_words(one, rules) != [] and 0
            size, span = sum(len(w[0]) + 1 for w in one) - 1, one[-1][2] - one[0][1]
            if b - a > 1 and (size > 40 or span > 4000):
                return float("inf")
            total += (10 if a else 0) + 4.0 * max(0, size - 20) + max(0, span - 2000) / 50 + (6 if b - a < 3 else 0)
            if b < len(words):
                last = one[-1][0]
                total += 0 if last[-1] in ".!?" else 4 if last[-1] in ",;:" else 12
                total += 15 if last.strip(".,").lower() in S._DANGLING else 0
                total -= min(8, max(0, words[b][1] - one[-1][2]) / 100)
        return total

    every = [list(c) for n in range(len(words)) for c in itertools.combinations(range(1, len(words)), n)]
    assert cost(best) == pytest.approx(min(map(cost, every)))


def test_reading_groups(spark):
    rows = [("v", 1, 0, 600, "Это", None), ("v", 2, 650, 1300, "был поздний", None), ("v", 3, 1350, 2600, "вечер.", None), ("v", 4, 20_000, 21_000, "Later.", None)]
    got = [(r.segment_ids, r.start_ms, r.end_ms) for r in S.reading_groups(spark.createDataFrame(rows, SEG)).orderBy("group").collect()]
    assert got == [([1, 2, 3], 0, 2600), ([4], 20_000, 21_000)]


def test_short_cues_and_captions(spark):
    cues = spark.createDataFrame([("v", 1, 0, 700, "The city sleeps.", "城"), ("v", 2, 850, 1450, "He wonders.", "他"), ("v", 3, 5000, 9000, "A long one follows here.", "长")], "video_id string, cue_id long, start_ms long, end_ms long, en_text string, zh_text string")
    assert [r.cue_ids for r in S.merge_short_cues(cues).orderBy("group").collect()] == [[1, 2], [3]]
    caps = spark.createDataFrame([("v", 1, 0, 5000, "a"), ("v", 2, 1000, 2000, "a"), ("v", 3, 1100, None, "b"), ("v", 4, None, 5, "x")], "video_id string, id long, start_ms long, end_ms long, text string")
    got = [(r.start_ms, r.end_ms, r.text) for r in S.deoverlap(caps).orderBy("seq").collect()]
    assert all(a[1] < b[0] for a, b in itertools.pairwise(got))
    assert [g[2] for g in got] == ["a", "a", "b"]


def test_difficult_spans(spark):
    rows = [("v", 1, 0, 2000, "The first part of a story", "的"), ("v", 2, 2100, 4000, "and the second part.", "第二部分。"), ("v", 3, 4100, 6000, "All fine here.", "这里都好。")]
    got = S.difficult_spans(spark.createDataFrame(rows, "video_id string, id long, start_ms long, end_ms long, source_text string, target_text string")).collect()
    assert [(r.start_id, r.end_id, r.severity) for r in got] == [(1, 2, "high")]


def test_difficult_spans_open_at_a_score_of_two(spark):
    rows = [
        ("v", 1, 0, 2000, "All is well here.", "这里一切都好。"), ("v", 2, 2100, 4000, "He left the old house.", "他离开了老房子，"), ("v", 3, 4100, 6000, "Nothing moved outside.", "外面没有动静。"),
        ("w", 1, 0, 2000, "He came back to", "他回到了那里。"), ("w", 2, 2100, 4000, "the empty house.", "空房子。"), ("x", 1, 0, 2000, "This one stays open", "这句没有结尾。"),
    ]
    got = S.difficult_spans(spark.createDataFrame(rows, "video_id string, id long, start_ms long, end_ms long, source_text string, target_text string")).collect()
    assert sorted((r.video_id, r.start_id, r.end_id, r.score, r.severity) for r in got) == [("v", 2, 3, 2, "low"), ("w", 1, 2, 3, "low")]


def test_span_severity():
    assert S.span_severity({"source_open_clause", "number_mismatch"}, 20) == "medium"
    assert S.span_severity({"target_open_ending", "source_ends_with_open_word"}, 10) == "high"
    assert S.span_severity({"target_open_ending", "source_ends_with_open_word"}, 9) == "medium"


def test_difficult_spans_of_defective_texts(spark):
    rows = [
        ("a", 1, 0, 4000, "He found the tape.", "他找到了 кассета 磁带。"), ("b", 1, 0, 4000, "Well, he found it.", "Well，他找到了那个东西。"), ("c", 1, 0, 4000, "Come back home. Stay here. Come back home!", "回家吧。留在这里。回家吧！"),
        ("d", 1, 0, 4000, "He found the tape.", "他找到了â€™磁带。"), ("e", 1, 0, 4000, "There is a door.", "there are 一扇门在那里。"), ("f", 1, 0, 4000, "I saw it. I saw him.", "我用 AI-so 看到了他。"), ("g", 1, 0, 4000, "Fine.", None),
    ]
    got = S.difficult_spans(spark.createDataFrame(rows, "video_id string, id long, start_ms long, end_ms long, source_text string, target_text string")).collect()
    assert sorted((r.video_id, r.score, r.severity) for r in got) == [("a", 6, "high"), ("b", 13, "high"), ("c", 4, "medium"), ("d", 6, "high"), ("e", 13, "high")]
    assert S.span_severity({"source_repeated_short_phrase"}, 8) == "high"
