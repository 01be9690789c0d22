from hypothesis import given, settings
from hypothesis import strategies as st

from reelspan.llm.structure import boundaries, split_oversized, split_text, word_times

ITEM = "item_kind string, video_id string, item_id long, version long, text string, words array<struct<word string, start_s double, end_s double, confidence double>>, piece string"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.,!?(\n -/中。，#", max_size=400), st.integers(1, 60))
def test_pieces_fit_and_keep_the_text(text, limit):
    pieces = split_text(text, limit)
    assert all(0 < len(p) <= limit for p, *_ in pieces)
    words = text.split()
    own = []
    for k, (piece, first, end, shared) in enumerate(pieces):
        parts = piece.split(" ")
        assert shared <= 1 and (k or not shared)
        own.append("".join(parts[shared:]))
        assert 0 <= first < end <= len(words)
    assert "".join(own) == "".join(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=8), min_size=1, max_size=60))
def test_one_word_is_shared(words):
    pieces = split_text(" ".join(words), 20)
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert b[3] == 1 and a[0].split()[-1] == b[0].split()[0]


def test_cuts_at_sentences_not_at_abbreviations():
    text = "The singer hid the letter in a basement (at 2.30 a.m., tape no. 9). By then 95 copies had been sold. The end came soon."
    got = [p for p, *_ in split_text(text, 70, 0)]
    assert got == ["The singer hid the letter in a basement (at 2.30 a.m., tape no. 9).", "By then 95 copies had been sold. The end came soon."]


def test_headings_and_lists_bind_stronger_than_sentences():
    words, strength = boundaries("# One\na b. c\n## Two\n- d\n  - e\n\nf")
    at = dict(zip(words, strength, strict=True))
    assert at["##"] > at["f"] > at["-"] > at["c"]


def test_long_words_are_cut_at_joints():
    got = [p for p, *_ in split_text("https://video.example/" + "abcdefgh/" * 10, 40)]
    assert all(p.endswith("/") for p in got[:-1])


def test_items(spark):
    words = [("one", 0.0, 0.4, 1.0), ("three", 0.9, 1.2, 1.0), None, (None, 1.0, 2.0, 1.0)]
    rows = [
        ("segment", "v", 1, 1, "one two three four", words, "clash"), ("segment", "v", 1, 2, "one two three four", words, "clash"), ("segment", "v", 2, 1, "short", None, ""), ("segment", "v", 3, 1, None, None, ""),
        ("segment", "v", 4, 1, " \n ", [], ""), ("cue", None, None, 1, "aaaa bbbb cccc", None, ""), ("other", "v", 5, 1, "x" * 999, None, ""),
    ]
    out = split_oversized(spark.createDataFrame(rows, ITEM), {"segment": 10, "cue": 9}).orderBy("item_kind", "item_id", "piece_no").collect()
    assert [(r.item_kind, r.item_id, r.piece, r.overlap_words, r.n_pieces) for r in out] == [
        ("cue", None, "aaaa bbbb", 0, 2), ("cue", None, "bbbb cccc", 1, 2), ("segment", 1, "one two", 0, 3), ("segment", 1, "two three", 1, 3), ("segment", 1, "three four", 1, 3),
    ]
    assert [(r.start_s, r.end_s) for r in out[2:]] == [(0.0, 0.4), (0.9, 1.2), (0.9, 1.2)]
    assert split_oversized(spark.createDataFrame([], ITEM), {"cue": 5}).count() == 0


def test_very_long_text():
    pieces = split_text("word, " * 50_000, 160)
    assert len(pieces) > 1000 and max(len(p) for p, *_ in pieces) <= 160


def test_times_go_on_after_any_number_of_unmatched_words():
    timed = [{"word": w, "start_s": float(k), "end_s": k + 0.5} for k, w in enumerate(["one", *(f"noise{x}" for x in range(40)), "two", "three", "four"])]
    assert [t[0] for t in word_times(["one", "two", *(f"gone{x}" for x in range(30)), "three", "four"], timed)] == [0.0, 41.0, *[None] * 30, 42.0, 43.0]
    assert word_times(["a"], None) == [(None, None)] and word_times([], timed) == []
    assert [t[0] for t in word_times(["x", "one", "z", "two"], timed[:1] + timed[41:])] == [None, 0.0, None, 41.0]
