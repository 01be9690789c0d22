"""Cutting oversized texts at natural boundaries by packing their structure tree."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.functions.text import fold

# Abbreviations after which a full stop ends no sentence, and words that open a clause.
ABBREVIATIONS = frozenset("a.m. approx. ca. cf. dr. e.g. etc. fig. i.e. mr. mrs. ms. no. nos. op. p. p.m. pp. prof. sr. st. tel. vol. vs. г. гг. др. им. кв. напр. пр. прим. см. стр. т.д. т.е. т.п. тыс. ул.".split())
CLAUSE_OPENERS = frozenset("after although and because before but if or since so that though unless until when where which while who yet а в где если и или когда который но однако поэтому потому пока что чтобы".split())

_SENTENCE_END = re.compile(r"(?<![.!?…。！？])[.!?…。！？]+[\"'”’»」』)\]）】]*$")
_CLAUSE_END = re.compile(r"(?<![,;:—–，、；：])[,;:—–，、；：]+[\"'”’»」』)\]）】]*$")
_HEADING = re.compile(r"^\s*(#{1,6})\s|^\s*<h([1-6])\b", re.I)
_ITEM = re.compile(r"^(\s*)(?:[-*+•]|\d+[.)]|<li\b)\s*", re.I)
_JOINT = re.compile(r".*[/\\\-_.,;:=&?。！？，、；]", re.S)
_OPEN, _CLOSE = "([{（【«“「『", ")]}）】»”」』"
# Strengths of the boundary before a word; headings of level h have 9 - 0.1 h.
_BLOCK, _LINE, _NESTED, _SENTENCE, _CLAUSE, _OPENER, _WORD, _INSIDE = 8, 7, 6, 4, 3, 2, 1, 0


def boundaries(text: str) -> tuple[list[str], list[float]]:
    """The words of a text, and of the boundary before each the strength: its height in the structure tree."""
    words: list[str] = []
    strength: list[float] = []
    opening: float = _LINE
    depth = 0
    for line in re.split(r"\r\n|[\n\r  \u0085\x0b\x0c]", text):
        parts = line.split()
        if not parts:
            opening = max(opening, _BLOCK)
            continue
        if h := _HEADING.match(line):
            opening = 9 - 0.1 * int(len(h[1]) if h[1] else h[2])
        elif item := _ITEM.match(line):
            opening = max(opening, _LINE - min(0.9, 0.1 * len(item[1].expandtabs(4))))
        for k, word in enumerate(parts):
            if k == 0:
                strength.append(opening)
                depth = 0
            else:
                last, low = words[-1], words[-1].lower().lstrip(_OPEN)
                inner = 0.5 if depth > 0 else 0  # inside brackets or quotes a boundary is weaker
                if _SENTENCE_END.search(last) and not (low in ABBREVIATIONS or re.fullmatch(r"\w\.", low) or (last.endswith(".") and (word[0].islower() or word[0].isdigit()) and low.rstrip(".").isdigit())):
                    strength.append((_SENTENCE if word[:1].isupper() or not word[:1].isalpha() or not last.endswith(".") else _CLAUSE) - 2 * inner)
                elif _CLAUSE_END.search(last) or word[0] in _OPEN or last[-1] in _CLOSE:
                    strength.append(_CLAUSE - 2 * inner)
                elif word.lower().strip(_OPEN) in CLAUSE_OPENERS:
                    strength.append(_OPENER - inner)
                else:
                    strength.append(_WORD - inner)
            words.append(word)
            depth = max(0, depth + sum(word.count(c) for c in _OPEN) - sum(word.count(c) for c in _CLOSE))
        opening = _LINE
    return words, strength


def split_text(text: str, limit: int, overlap: int = 1) -> list[tuple[str, int, int, int]]:
    """Pieces of at most ``limit`` characters: (piece, first word, end word, words of overlap it starts with).

    Blanks and line breaks are folded. A subtree that fits is placed whole with its siblings before it or
    in a fresh piece; only one that fits neither is descended into: sections, blocks, lines and list
    items, sentences, clauses, words. A word over the limit is cut after a joint such as a slash, else
    anywhere. Each piece but the first starts with the last ``overlap`` words of the piece before, as many as leave room for its own first word.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    words, strength = boundaries(text)
    atoms: list[tuple[str, int, bool]] = []  # text, word, whether a blank stands before it
    heights: list[float] = []
    for w, word in enumerate(words):
        first = True
        while word:
            cut = len(word)
            if cut > limit:
                joint = _JOINT.match(word[:limit])
                cut = joint.end() if joint and joint.end() > limit // 2 else limit
            atoms.append((word[:cut], w, first))
            heights.append(strength[w] if first else _INSIDE - 1)
            word, first = word[cut:], False
    sums = [0]
    for t, _, blank in atoms:
        sums.append(sums[-1] + len(t) + blank)

    def length(a: int, b: int) -> int:
        return sums[b] - sums[a] - atoms[a][2]

    def start(a: int) -> int:
        """The first atom of a piece whose own content begins at ``a``."""
        s = a
        while s > 0 and a - s < overlap and length(s - 1, a + 1) <= limit:
            s -= 1
        return s

    pieces: list[list[int]] = []  # own first atom, end
    todo = [(0, len(atoms))] if atoms else []
    while todo:
        a, b = todo.pop()
        if pieces and pieces[-1][1] == a and length(start(pieces[-1][0]), b) <= limit:
            pieces[-1][1] = b
        elif length(start(a), b) <= limit:
            pieces.append([a, b])
        else:
            top = max(heights[a + 1 : b])
            cuts = [a, *(k for k in range(a + 1, b) if heights[k] == top), b]
            todo += reversed(list(zip(cuts, cuts[1:], strict=False)))
    out = []
    for a, b in pieces:
        s = start(a)
        body = "".join((" " if blank and k else "") + t for k, (t, _, blank) in enumerate(atoms[s:b]))
        out.append((body, atoms[s][1], atoms[b - 1][1] + 1, a - s))
    return out


def word_times(words: list[str], timed: list[dict] | None) -> list[tuple[float | None, float | None]]:
    """Times of each word of the text, in order; words that are missing among the timed ones have none.

    Where the two differ, whichever side comes to the other's word sooner is passed over, however far that is."""
    timed = [t for t in (timed if timed is not None else []) if t is not None and t["word"] is not None]
    said = [t["word"].strip() for t in timed]
    places: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
    for where, side in zip(places, (words, said), strict=True):
        for k, word in enumerate(side):
            where.setdefault(word, []).append(k)

    def steps(where: dict[str, list[int]], word: str, at: int) -> float:
        """How far it is to the next place of a word."""
        found = where.get(word, ())
        k = bisect_left(found, at)
        return found[k] - at if k < len(found) else math.inf

    out: list[tuple[float | None, float | None]] = [(None, None)] * len(words)
    i = j = 0
    while i < len(words) and j < len(said):
        if words[i] == said[j]:
            out[i] = (timed[j]["start_s"], timed[j]["end_s"])
            i, j = i + 1, j + 1
            continue
        text, clock = steps(places[0], said[j], i), steps(places[1], words[i], j)
        if text == clock == math.inf:
            i, j = i + 1, j + 1
        elif clock <= text:
            j += int(clock)
        else:
            i += int(text)
    return out


SCHEMA = "item_kind string, video_id string, item_id bigint, piece_no int, n_pieces int, piece string, overlap_words int, start_s double, end_s double"


def split_oversized(items: DataFrame, limits: dict[str, int], *, overlap: int = 1) -> DataFrame:
    """Pieces of the items (``item_kind, video_id, item_id, version, text, words``) over their kind's limit.

    The size is the number of code points after folding blanks; items within their limit don't come out. Rows of one
    key count once: the latest oversized version. ``start_s, end_s`` span the timed words of the
    piece, null where none is timed. No shuffle but that of the oversized items; no item is held against another.

    Cases: null and blank texts are no items over a limit; a kind without a limit is never cut; null or
    empty ``words`` leave times null; null ``video_id`` or ``item_id`` are values like others.
    """
    limit = F.coalesce(*[F.when(F.col("item_kind") == k, F.lit(v)) for k, v in limits.items()])
    big = items.where(F.length(fold(F.col("text"))) > limit)
    big = big.groupBy("item_kind", "video_id", "item_id").agg(F.max_by(F.struct("text", "words"), F.struct("version", "text")).alias("x")).select("item_kind", "video_id", "item_id", "x.text", "x.words")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for kind, video, item, text, timed in zip(pdf["item_kind"], pdf["video_id"], pdf["item_id"], pdf["text"], pdf["words"], strict=True):
                pieces = split_text(text, limits[kind], overlap)
                times = word_times(text.split(), timed)
                for k, (piece, first, end, shared) in enumerate(pieces, 1):
                    a = [x for x, _ in times[first:end] if x is not None]
                    b = [x for _, x in times[first:end] if x is not None]
                    rows.append((kind, video, item, k, len(pieces), piece, shared, min(a, default=None), max(b, default=None)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"item_id": "Int64"})

    return big.mapInPandas(cut, SCHEMA)
