"""Re-segmentation of timed text: splits at pauses and sentences, merges of fragments, optimal grouping of words.

Folds run in pandas over one island of a video: a stretch of rows between pauses so long that no rule reaches across.
Islands come from running sums over time shards, so no video is gathered into one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions import rules as R
from reelspan.operators.quality import risk_codes
from reelspan.operators.sequences import islands, renumber, running_max


@dataclass(frozen=True)
class SubtitleRules:
    """Limits of subtitles, in milliseconds and characters."""

    max_ms: int = 6500
    line_chars: int = 42
    max_lines: int = 2
    pause_ms: int = 550
    strong_pause_ms: int = 1200
    sentence_gap_ms: int = 220
    min_chars: int = 8
    orphan_words: int = 5
    orphan_ms: int = 1600
    #: Pause over which nothing is ever joined.
    island_ms: int = 5000


@dataclass(frozen=True)
class ReadingRules:
    """Limits of reading groups, in milliseconds."""

    target_min_ms: int = 3500
    target_max_ms: int = 7500
    hard_max_ms: int = 8500
    min_ms: int = 2200
    merge_gap_ms: int = 450
    strong_gap_ms: int = 1000
    max_cps: float = 18.0
    part_chars: int = 56
    max_parts: int = 3


_TERMINAL = re.compile(r"[.!?。！？…][\"'”’)\]]*$")
_CLAUSE = re.compile(r"[,;:—，；：][\"'”’)\]]*$")
_DANGLING = frozenset((*R.OPEN_END_WORDS, "but", "or", "that", "и", "а", "но", "в", "на", "с", "к", "у", "от", "до", "по", "за", "из", "что"))


def word_rows(segments: DataFrame) -> DataFrame:
    """Words of segments with usable times: ``video_id, id, place, word, start_ms, end_ms``."""
    exploded = segments.select("video_id", "id", F.posexplode("words").alias("place", "w"))
    rows = exploded.select("video_id", "id", "place", F.col("w.word").alias("word"), F.round(F.col("w.start_s") * 1000).cast("bigint").alias("start_ms"), F.round(F.col("w.end_s") * 1000).cast("bigint").alias("end_ms"))
    return rows.where("word IS NOT NULL AND start_ms IS NOT NULL AND end_ms >= start_ms")


def pause_splits(segments: DataFrame, *, pause_ms: int = 1200) -> DataFrame:
    """Pieces of segments between pauses of ``pause_ms`` or more: ``video_id, id, piece, n_words, start_ms, end_ms, text``. Segments without timed words have none."""
    by = Window.partitionBy("video_id", "id").orderBy("place")
    gap = F.col("start_ms") - F.lag("end_ms").over(by)
    rows = word_rows(segments).withColumn("_new", F.when(gap >= pause_ms, 1).otherwise(0)).withColumn("piece", F.sum("_new").over(by) + 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x.word), " ")
    return rows.groupBy("video_id", "id", "piece").agg(F.count(F.lit(1)).alias("n_words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), text.alias("text"))


def sentence_cuts(words: Sequence[tuple[str, int, int]], rules: SubtitleRules) -> list[int]:
    """Places before which a run of words is cut: at strong pauses, and after sentences that are long enough if a pause or a capital follows."""
    cuts, since = [], 0
    for k in range(1, len(words)):
        before, start = words[k - 1], words[k][1]
        gap = max(0, start - before[2])
        size = sum(len(w[0]) + 1 for w in words[since:k]) - 1
        ended = bool(_TERMINAL.search(before[0])) and size >= rules.min_chars
        capital = words[k][0].strip()[:1].isupper()
        if gap >= rules.strong_pause_ms or (ended and (capital or gap >= rules.pause_ms)):
            cuts.append(k)
            since = k
    return cuts


def group_words(words: Sequence[tuple[str, int, int]], rules: SubtitleRules) -> list[int]:
    """Cuts that cost least over a whole run of words, by dynamic programming over the place of the last cut.

    A group costs what it is over its limits of time and characters, its distance from an even share, and an edge on a function word or inside a clause;
    each cut costs ten. Groups over twice the characters or time are left out unless they are one word.
    """
    n = len(words)
    if not n:
        return []
    limit = rules.line_chars * rules.max_lines
    chars = [0]
    for w in words:
        chars.append(chars[-1] + len(w[0]) + 1)
    best = [0.0] + [float("inf")] * n
    back = [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(end - 1, -1, -1):
            size, span = chars[end] - chars[start] - 1, words[end - 1][2] - words[start][1]
            if end - start > 1 and (size > 2 * limit or span > 2 * rules.max_ms):
                break
            cost = best[start] + (10 if start else 0) + 4.0 * max(0, size - limit) + max(0, span - rules.max_ms) / 50
            cost += 6 if end - start < 3 and n > 3 else 0
            if end < n:
                last = words[end - 1][0]
                cost += 0 if _TERMINAL.search(last) else 4 if _CLAUSE.search(last) else 12
                cost += 15 if re.sub(r"\W", "", last).lower() in _DANGLING else 0
                cost -= min(8, max(0, words[end][1] - words[end - 1][2]) / 100)
            if cost < best[end]:
                best[end], back[end] = cost, start
    cuts, at = [], n
    while at:
        at = back[at]
        if at:
            cuts.append(at)
    return cuts[::-1]


def joins_next(left: dict, right: dict, rules: SubtitleRules) -> bool:
    """Whether a fragment and what follows it are one subtitle."""
    gap, span = max(0, right["start_ms"] - left["end_ms"]), right["end_ms"] - left["start_ms"]
    ended, size = bool(_TERMINAL.search(left["text"])), len(left["text"]) + 1 + len(right["text"])
    if span > rules.max_ms + 350 or size > rules.line_chars * rules.max_lines * 1.1:
        return False
    first = right["text"].lstrip()[:1]
    if ended and not first.islower():
        return False
    short = len(left["text"].split()) <= rules.orphan_words or left["end_ms"] - left["start_ms"] <= rules.orphan_ms
    tail = len(right["text"].split()) <= 2 and first.islower()
    edge = re.sub(r"\W", "", left["text"].split()[-1]).lower() in _DANGLING if left["text"].split() else False
    return (tail and gap <= rules.strong_pause_ms) or (not ended and short and gap <= rules.pause_ms) or (not ended and gap <= rules.sentence_gap_ms) or (edge and gap <= rules.strong_pause_ms)


def retime(rows: list[dict], rules: SubtitleRules) -> list[dict]:
    """Segments of one island, re-cut: pauses and sentences, then merges of fragments, then cuts of what is too long, at least cost."""
    cut: list[dict] = []
    for row in rows:
        words = row["words"]
        if len(words) < 2:
            cut.append({k: row[k] for k in ("ids", "start_ms", "end_ms", "text", "words")})
            continue
        places = [0, *sentence_cuts(words, rules), len(words)]
        for a, b in zip(places, places[1:], strict=False):
            cut.append({"ids": row["ids"], "start_ms": words[a][1], "end_ms": words[b - 1][2], "text": " ".join(w[0] for w in words[a:b]), "words": words[a:b]})
    merged: list[dict] = []
    for row in cut:
        if merged and joins_next(merged[-1], row, rules):
            left = merged[-1]
            whole = bool(left["words"]) and bool(row["words"])
            merged[-1] = {"ids": list(dict.fromkeys([*left["ids"], *row["ids"]])), "start_ms": left["start_ms"], "end_ms": max(left["end_ms"], row["end_ms"]), "text": f"{left['text']} {row['text']}".strip(), "words": [*left["words"], *row["words"]] if whole else []}
        else:
            merged.append(row)
    out: list[dict] = []
    for row in merged:
        long = row["end_ms"] - row["start_ms"] > rules.max_ms or len(row["text"]) > rules.line_chars * rules.max_lines
        places = [0, *(group_words(row["words"], rules) if long else []), len(row["words"])]
        if len(places) == 2:
            out.append(row)
            continue
        for a, b in zip(places, places[1:], strict=False):
            w = row["words"][a:b]
            out.append({"ids": row["ids"], "start_ms": w[0][1], "end_ms": w[-1][2], "text": " ".join(x[0] for x in w), "words": w})
    return out


def _by_island(df: DataFrame, gap_ms: int) -> DataFrame:
    """``df`` with ``island``: rows that start within ``gap_ms`` of the furthest end before them stay together."""
    near = running_max(df, ["video_id"], F.col("end_ms"), "_reach")
    opens = F.coalesce(F.col("start_ms") - F.col("_reach") > gap_ms, F.lit(True))
    return islands(near.withColumn("_opens", opens).drop("_reach"), ["video_id"], F.col("_opens"), "island").drop("_opens")


def _fold(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy("video_id", "island").applyInPandas(work, schema)


def refine_timing(segments: DataFrame, rules: SubtitleRules = SubtitleRules()) -> DataFrame:
    """``video_id, seq, source_ids, start_ms, end_ms, text``: segments re-cut into subtitles and numbered anew.

    Segments without timed words keep their text whole. Cases: segments without text or times are left out; null ``words`` are none;
    a segment that came whole stays whole.
    """
    text = R.squash(F.col("source_text"))
    timed = F.filter(F.coalesce("words", F.array().cast(segments.schema["words"].dataType)), lambda w: w.word.isNotNull() & w.start_s.isNotNull() & w.end_s.isNotNull())
    whole = R.squash(F.array_join(F.transform(timed, lambda w: w.word), " ")) == text  # words that are missing would be lost
    rows = segments.where((text != "") & F.col("start_ms").isNotNull() & (F.col("end_ms") > F.col("start_ms"))).select("video_id", "id", "start_ms", "end_ms", text.alias("text"), F.when(whole, timed).alias("timed"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_ms", "end_ms", "id"])
        made = []
        for r in pdf.itertuples():
            words = [(w["word"].strip(), round(w["start_s"] * 1000), round(w["end_s"] * 1000)) for w in r.timed] if r.timed is not None else []
            made.append({"ids": [r.id], "start_ms": r.start_ms, "end_ms": r.end_ms, "text": r.text, "words": words})
        out = retime(made, rules)
        video = pdf["video_id"].iloc[0]
        return pd.DataFrame({"video_id": [video] * len(out), "source_ids": [x["ids"] for x in out], "start_ms": [x["start_ms"] for x in out], "end_ms": [x["end_ms"] for x in out], "text": [x["text"] for x in out]})

    cut = _fold(_by_island(rows, rules.island_ms), work, "video_id string, source_ids array<bigint>, start_ms bigint, end_ms bigint, text string")
    return renumber(cut.withColumn("id", F.col("source_ids")[0]), ["video_id"], order=("start_ms", "end_ms", "id", "text")).select("video_id", "seq", "source_ids", "start_ms", "end_ms", "text")


def close_group(text: str, span: int, gap: int, next_span: int, would: int, rules: ReadingRules) -> bool:
    """Whether a reading group ends here, by its length, its end and the gap after it."""
    if span >= rules.hard_max_ms or (would > rules.hard_max_ms and span >= rules.min_ms):
        return True
    words = re.findall(r"[\w']+", text.lower())
    if words and words[-1] in _DANGLING and not _TERMINAL.search(text):
        return False
    ended = bool(_TERMINAL.search(text))
    if gap >= rules.strong_gap_ms and span >= rules.min_ms:
        return True
    if ended and (span >= rules.target_min_ms or (gap >= rules.merge_gap_ms and span >= rules.min_ms)):
        return True
    return span >= rules.target_max_ms and (ended or bool(_CLAUSE.search(text)) or gap >= rules.merge_gap_ms or next_span > 0)


def reading_groups(segments: DataFrame, rules: ReadingRules = ReadingRules(), *, island_ms: int = 5000) -> DataFrame:
    """``video_id, group, segment_ids, start_ms, end_ms, text``: neighbours joined until a group reads well. Pauses of ``island_ms`` always end one."""
    text = R.squash(F.col("source_text"))
    rows = segments.where((text != "") & F.col("start_ms").isNotNull() & (F.col("end_ms") > F.col("start_ms"))).select("video_id", "id", "start_ms", "end_ms", text.alias("text"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["start_ms", "end_ms", "id"]).to_dict("records")
        groups, own = [], []
        for k, row in enumerate(rows):
            own.append(row)
            after = rows[k + 1] if k + 1 < len(rows) else None
            tail = row["text"] if re.search(r"\w", row["text"]) else " ".join(r["text"] for r in own)  # only the end of the text is looked at
            if after is None or close_group(tail, own[-1]["end_ms"] - own[0]["start_ms"], max(0, after["start_ms"] - row["end_ms"]), after["end_ms"] - after["start_ms"], after["end_ms"] - own[0]["start_ms"], rules):
                groups.append((row["video_id"], [r["id"] for r in own], own[0]["start_ms"], own[-1]["end_ms"], " ".join(r["text"] for r in own)))
                own = []
        return pd.DataFrame(groups, columns=["video_id", "segment_ids", "start_ms", "end_ms", "text"])

    made = _fold(_by_island(rows, island_ms), work, "video_id string, segment_ids array<bigint>, start_ms bigint, end_ms bigint, text string")
    return renumber(made.withColumn("id", F.col("segment_ids")[0]), ["video_id"], "group").select("video_id", "group", "segment_ids", "start_ms", "end_ms", "text")


def display_parts(segments: DataFrame, rules: ReadingRules = ReadingRules()) -> DataFrame:
    """``video_id, id, part, n_parts, start_ms, end_ms``: targets that are too long, too fast or last too long in up to three parts of equal time."""
    text, span = R.visible_length(F.col("target_text")), F.col("end_ms") - F.col("start_ms")
    cps = text * 1000 / span
    over = (span > rules.hard_max_ms) | (text > rules.part_chars) | (cps > rules.max_cps)
    wanted = F.greatest(F.ceil(span / rules.target_max_ms), F.ceil(text / rules.part_chars), F.ceil(cps / rules.max_cps))
    n = F.when(over, F.least(F.lit(rules.max_parts), wanted, F.greatest(F.lit(1), F.floor(span / rules.min_ms)))).otherwise(1).cast("int")
    rows = segments.where((text > 0) & F.col("start_ms").isNotNull() & (span > 0)).withColumn("n_parts", n)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("n_parts"))))
    return rows.select("video_id", "id", "part", "n_parts", (F.col("start_ms") + F.floor(span * (F.col("part") - 1) / F.col("n_parts"))).alias("start_ms"), (F.col("start_ms") + F.floor(span * F.col("part") / F.col("n_parts"))).alias("end_ms"))


def deoverlap(captions: DataFrame, *, min_ms: int = 700, max_ms: int = 6000, gap_ms: int = 40, repeat_ms: int = 1000, island_ms: int = 10_000) -> DataFrame:
    """``video_id, seq, start_ms, end_ms, text``: captions clipped to the next start, capped, pushed behind the one before, quick repeats dropped."""
    rows = captions.where("start_ms IS NOT NULL AND text IS NOT NULL").withColumn("end_ms", F.coalesce("end_ms", F.col("start_ms") + 2000))
    rows = rows.withColumn("end_ms", F.least("end_ms", F.col("start_ms") + max_ms))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_ms", "end_ms", "text"]).reset_index(drop=True)
        out: list[list] = []
        starts = pdf["start_ms"].tolist()
        for k, (start, end, text) in enumerate(zip(starts, pdf["end_ms"].tolist(), pdf["text"].tolist(), strict=True)):
            if k + 1 < len(starts):
                end = min(end, max(start + min_ms, starts[k + 1] - gap_ms))
            end = end if end > start else start + min_ms
            if out and start < out[-1][1]:
                start = out[-1][1] + gap_ms
                end = max(end, start + min_ms)
            if not (out and text == out[-1][2] and start - out[-1][0] < repeat_ms):
                out.append([start, end, text])
        frame = pd.DataFrame(out, columns=["start_ms", "end_ms", "text"])
        return frame.assign(video_id=pdf["video_id"].iloc[0] if len(pdf) else None)

    made = _fold(_by_island(rows, island_ms), work, "video_id string, start_ms bigint, end_ms bigint, text string")
    return renumber(made.withColumn("id", F.col("text")), ["video_id"]).select("video_id", "seq", "start_ms", "end_ms", "text")


def merge_short_cues(cues: DataFrame, *, max_single_ms: int = 1200, max_gap_ms: int = 350, max_group_ms: int = 3500, max_chars: int = 56, island_ms: int = 5000) -> DataFrame:
    """``video_id, group, cue_ids, start_ms, end_ms, text``: runs of short whole sentences shown together."""
    rows = cues.where("start_ms IS NOT NULL AND end_ms > start_ms").select("video_id", F.col("cue_id").alias("id"), "start_ms", "end_ms", R.squash(F.col("en_text")).alias("text"), R.visible_length(F.col("zh_text")).alias("zh"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for row in pdf.sort_values(["start_ms", "end_ms", "id"]).to_dict("records"):
            short = row["end_ms"] - row["start_ms"] <= max_single_ms and bool(_TERMINAL.search(row["text"]))
            last = out[-1] if out else None
            if last and short and last["short"] and row["start_ms"] - last["end_ms"] <= max_gap_ms and row["end_ms"] - last["start_ms"] <= max_group_ms and last["zh"] + row["zh"] <= max_chars:
                last["cue_ids"].append(row["id"])
                last |= {"end_ms": max(last["end_ms"], row["end_ms"]), "text": f"{last['text']} {row['text']}", "zh": last["zh"] + row["zh"]}
            else:
                out.append({"video_id": row["video_id"], "cue_ids": [row["id"]], "start_ms": row["start_ms"], "end_ms": row["end_ms"], "text": row["text"], "zh": row["zh"], "short": short})
        return pd.DataFrame(out, columns=["video_id", "cue_ids", "start_ms", "end_ms", "text"])

    made = _fold(_by_island(rows, island_ms), work, "video_id string, cue_ids array<bigint>, start_ms bigint, end_ms bigint, text string")
    return renumber(made.withColumn("id", F.col("cue_ids")[0]), ["video_id"], "group").select("video_id", "group", "cue_ids", "start_ms", "end_ms", "text")


def span_severity(codes: set[str], score: int) -> str:
    """Severity of a span by all codes and the score of its segments."""
    edge = bool(codes & {"source_starts_with_continuation", "source_ends_with_open_word"})
    if codes & {"target_too_short", "target_text_pollution", "target_untranslated_discourse_marker", "target_short_english_leak"}:
        return "high"
    if ("source_repeated_short_phrase" in codes and score >= 8) or ("target_open_ending" in codes and edge and score >= 10):
        return "high"
    return "medium" if score >= 4 else "low"


def difficult_spans(segments: DataFrame, *, least: int = 2, most: int = 10, island_ms: int = 30_000) -> DataFrame:
    """``video_id, start_id, end_id, n_segments, score, severity``: around each segment with a risk score of ``least`` (2) or more, the neighbours that belong to its sentence.

    Spans that touch are one, cut to ``most`` segments: a segment with risk that reaches back to a span that is already full opens none of its own.
    """
    texts = segments.withColumns({"source_text": R.squash(F.col("source_text")), "target_text": R.squash(F.col("target_text"))})
    codes = risk_codes(F.col("source_text"), F.col("target_text"), F.col("start_ms"), F.col("end_ms"))
    rows = texts.where("start_ms IS NOT NULL AND end_ms > start_ms").select(
        "video_id", "id", "start_ms", "end_ms", R.ends_sentence(F.col("source_text")).alias("ended"), R.opens_with_continuation(F.col("source_text")).alias("goes_on"),
        F.array_join(F.transform(codes, lambda c: F.concat_ws(":", c.code, c.weight)), ",").alias("codes"),
    )

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["start_ms", "end_ms", "id"]).to_dict("records")
        for row in rows:
            row["codes"] = {code: int(w) for code, w in (c.split(":") for c in row["codes"].split(",") if c)}
            row["score"] = sum(row["codes"].values())
        ranges: list[list[int]] = []
        for k, row in enumerate(rows):
            if row["score"] < least:
                continue
            a = b = k
            while a > 0 and b - a + 1 < most and not (rows[a - 1]["ended"] and not rows[a]["goes_on"]):
                a -= 1
            while b + 1 < len(rows) and b - a + 1 < most and (not rows[b]["ended"] or rows[b + 1]["goes_on"] or "target_open_ending" in rows[b]["codes"] or "source_ends_with_open_word" in rows[b]["codes"]):
                b += 1
            if ranges and a <= ranges[-1][1] + 1:
                ranges[-1][1] = min(max(ranges[-1][1], b), ranges[-1][0] + most - 1)
            else:
                ranges.append([a, b])
        out = []
        for a, b in ranges:
            part = rows[a : b + 1]
            score = sum(r["score"] for r in part)
            found = {c for r in part for c in r["codes"]}
            out.append((part[0]["video_id"], part[0]["id"], part[-1]["id"], len(part), score, span_severity(found, score)))
        return pd.DataFrame(out, columns=["video_id", "start_id", "end_id", "n_segments", "score", "severity"])

    return _fold(_by_island(rows, island_ms), work, "video_id string, start_id bigint, end_id bigint, n_segments int, score int, severity string")
