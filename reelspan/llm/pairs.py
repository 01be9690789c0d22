"""Defects of prompt and response pairs: empty, copied, refused, in a wrong language, truncated."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.llm.hyper import sentence_text
from reelspan.llm.labels import LANGUAGES
from reelspan.llm.refusals import APOLOGISING, DECLINING

#: Buckets of the hashed n-gram tables: their size is fixed, whatever the corpus.
BITS = 17
STOP_BITS = 18
#: Log odds, before a pair is looked at, that its target is whole; and the most that its length may add or take (less: length alone decides nothing).
WHOLE, LENGTH_MOST = 1.5, 1.2
#: Weight of the shorter context when the end counts of two signs are few, and of the overall rate when those of one sign are.
BACKOFF = 2.0
#: Weight of the examples' n-grams in the likelihoods of a refusal and of any other text; the rest is that of all lines.
MIXED, MIXED_OWN = 0.6, 0.15
#: Log odds from which a text declines, and how far they must be over its source's.
DECLINES, DECLINES_MORE = 13.0, 8.0
#: Likeness of letter pairs from which a target repeats its source, and from which it does if both are surely in one language.
COPY, COPY_SAME = 0.75, 0.65

_SIGNS = "㐀-鿿"
# What stands for a missing translation, and words put before one.
FILLERS = frozenset("n/a na null none nil nan undefined tbd todo empty untranslated missing blank notranslation notranslationavailable 无 空 略 无译文 暂无 暂无译文 未翻译 待翻译 没有译文 空白 нет пусто безперевода нетперевода".split())
_PREFIX = re.compile(r"^\s*(?:[-–—*•>]+\s*)?(?:译文|翻译|中文|译|translation|target|перевод)\s*[:：]\s*", re.I)
_MARKUP = re.compile(r"\{[^{}]*\}|<[^<>]*>|\\[Nnh]|[​-‏⁠﻿­]")
_CARRIED = re.compile(r"[^\s㐀-鿿぀-ヿ。，、？！：；（）《》“”]{24,}|[^\s㐀-鿿぀-ヿ。，、？！]*(?:[/\\#_@]|https?:)[^\s㐀-鿿぀-ヿ。，、？！]*")
_MARKUP_SIGN = re.compile(r"[{<\\​-‏⁠﻿­]")
_CARRIED_SIGN = re.compile(r"[/\\#_@]|https?:|[^\s㐀-鿿぀-ヿ。，、？！：；（）《》“”]{24}")
_LETTERS = re.compile(r"[^\W\d_]")
_KANA = re.compile("[぀-ゟ゠-ヿ]")
_PLAIN = re.compile(r"[\W_]+")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_CYRILLIC_LETTERS = re.compile("[Ѐ-ӿ]+")
_NO_SIGNS = re.compile(f"[^{_SIGNS}]+")

_TERMINAL = ".!?…。！？"
_CLOSERS = " \t\n\r　 \"'”’»」』)]）】>*"
_OPEN_MARK = re.compile(r"(?:[,，、;；:：\-–—‐·…]|\.\.+)$")
_TAIL = re.compile(r"[\W_]+$")
_BREAKS = re.compile(r"(?<![,;:.!?…，；：。！？])(?:[,;:.!?…，；：。！？]+(?=\s|$|[㐀-鿿\"”’»」)])|[，；：。！？]+)")
_ASIDE = re.compile(r"\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]")


def core(text: str | None) -> str:
    """A target without markup, invisible signs and words put before a translation."""
    text = text or ""
    return _PREFIX.sub("", _MARKUP.sub("", text) if _MARKUP_SIGN.search(text) else text).strip()


def is_empty(target: str) -> bool:
    """Whether nothing is left that could be a translation, or only a filler."""
    plain = re.sub(r"[^\w/]+|_", "", target).lower()
    return not re.search(r"\w", plain) or plain in FILLERS


def likeness(a: str, b: str) -> float:
    """Shared letter pairs of two texts, by the Dice ratio of their multisets, case and punctuation aside."""
    a, b = _PLAIN.sub("", a).lower(), _PLAIN.sub("", b).lower()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = Counter(zip(a, a[1:], strict=False)), Counter(zip(b, b[1:], strict=False))
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


#: First code points of Latin with diacritics, Cyrillic, further scripts, kana, CJK signs and what follows.
_SCRIPTS = np.array([0x80, 0x400, 0x530, 0x3040, 0x3100, 0x3400, 0xA000], dtype=np.uint64)


def hashed(texts: Sequence[str], orders: Sequence[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter n-grams of the texts (order 0: their scripts), and the text of each."""
    joined = "".join(f" {t} " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts)))
    keys, of = [], []
    with np.errstate(over="ignore"):
        for n in orders:
            if n == 0:  # the script alone, for letters never seen
                script = np.searchsorted(_SCRIPTS, points, side="right")
                keys.append(script[points > 64].astype(np.int64))
                of.append(owner[points > 64])
                continue
            size = max(0, len(points) - n + 1)
            key = np.full(size, n, dtype=np.uint64)
            for k in range(n):
                key = key * np.uint64(0x100000001B3) ^ points[k : k + size]
            inside = owner[:size] == owner[n - 1 : n - 1 + size]
            key = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            keys.append(key[inside].astype(np.int64))
            of.append(owner[:size][inside])
    return np.concatenate(keys), np.concatenate(of)


def refusal_odds(lines: Sequence[str], declining: dict[str, Sequence[str]], apologising: dict[str, Sequence[str]]) -> np.ndarray:
    """Log odds of each bucket of letter pairs and triples in a refusal against any other text: the examples' shares, each language weighing as much, mixed with those of all lines."""

    def shares(groups: Iterable[Sequence[str]]) -> np.ndarray:
        out = np.zeros(1 << BITS)
        for texts in groups:
            keys, _ = hashed(texts, (2, 3), BITS)
            out += np.bincount(keys, minlength=1 << BITS) / max(1, len(keys))
        return out / max(1e-9, out.sum())

    plain = shares(lines[at : at + 1000] for at in range(0, len(lines), 1000))
    said, own = (shares([_letters(t) for t in texts] for texts in x.values()) for x in (declining, apologising))
    least = 0.5 / (1 << BITS)
    return np.where((said > 0) | (own > 0) | (plain > 0), np.log((MIXED * said + (1 - MIXED) * plain + least) / (MIXED_OWN * own + (1 - MIXED_OWN) * plain + least)), 0)


class LanguageBayes:
    """Naive Bayes over hashed letter n-grams of orders 1 to 3 and their scripts: languages, and how much likelier an n-gram is in a refusal."""

    ORDERS = (0, 1, 2, 3)

    def __init__(self, table: np.ndarray, languages: Sequence[str] = LANGUAGES):
        self.table, self.languages = table.astype(np.float32), tuple(languages)

    @classmethod
    def fit(cls, sample: Sequence[tuple[str, str]], languages: Sequence[str] = LANGUAGES, rounds: int = 2, declining: dict[str, Sequence[str]] = DECLINING, apologising: dict[str, Sequence[str]] = APOLOGISING) -> LanguageBayes:
        """From labelled texts (a bounded sample), and examples of refusals and of what else is said in like words.

        Labels may be wrong: lines that the first fit puts clearly into another language go there in the second."""
        lines = [(languages.index(lang), t) for lang, text in sample if lang in languages for line in text.split("\n") if len(t := sentence_text(line)) > 3]
        if not lines:
            raise ValueError("no labelled text to fit languages on")
        label = np.array([k for k, _ in lines])
        for step in range(rounds):
            counts = np.zeros(len(languages) << BITS, dtype=np.int64)
            for at in range(0, len(lines), 1000):
                keys, of = hashed([t for _, t in lines[at : at + 1000]], cls.ORDERS, BITS)
                counts += np.bincount((label[at : at + 1000][of] << BITS) + keys, minlength=len(counts))
            table = counts.reshape(len(languages), -1).astype(np.float64)
            size = np.maximum(table.sum(axis=1, keepdims=True), 1)
            table = table * size.mean() / size + 0.05  # unseen n-grams weigh the same in every language
            model = cls(np.c_[np.log(table / table.sum(axis=1, keepdims=True)).T, np.zeros(1 << BITS)], languages)
            if step < rounds - 1:
                for at in range(0, len(lines), 1000):
                    p = model.posteriors([t for _, t in lines[at : at + 1000]])
                    own = label[at : at + 1000]
                    label[at : at + 1000] = np.where(p.max(axis=1) > 0.99, p.argmax(axis=1), own)
        model.table[:, -1] = refusal_odds([t for _, t in lines], declining, apologising)
        return model

    def sums(self, texts: Sequence[str]) -> np.ndarray:
        """Of each text the log likelihood in each language and the log odds of a refusal."""
        out = np.zeros((len(texts), len(self.languages) + 1))
        if len(texts):
            keys, of = hashed(texts, self.ORDERS, BITS)
            keys, of = (x[np.argsort(of, kind="stable")] for x in (keys, of))
            if len(keys):
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                out[of[starts]] = np.add.reduceat(self.table[keys], starts, axis=0)
        return out

    def judged(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language posteriors (a row for each text, uniform without letters), and the log odds of a refusal."""
        out = self.sums(texts)
        p = np.exp(out[:, :-1] - out[:, :-1].max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), out[:, -1]

    def posteriors(self, texts: Sequence[str]) -> np.ndarray:
        """A row for each text, a column for each language, uniform for texts without letters."""
        return self.judged(texts)[0]


def _letters(text: str) -> str:
    return " ".join(_NO_LETTERS.sub(" ", text).split()).lower()


def _bare(text: str) -> str:
    """Without what stands in brackets."""
    return _ASIDE.sub(" ", text) if "(" in text or "（" in text or "[" in text else text


def _uncarried(text: str) -> str:
    """Without paths, links, tags and other long strings that go through a translation unchanged."""
    return _CARRIED.sub(" ", text) if _CARRIED_SIGN.search(text) else text


#: How a source ends: with a sentence, a question, or open.
_ENDED, _ASKED, _OPEN = range(3)
#: How a target ends: with a sentence's mark, a question mark, a mark after which text goes on, none.
_STOP_MARK, _ASK_MARK, _GOES_ON, _NO_MARK = range(4)


def clauses(text: str) -> tuple[list[str], str]:
    """The clauses of a text, asides left out, and the marks after the last."""
    text = _bare(text).rstrip(_CLOSERS)
    tail = _TAIL.search(text)
    marks = tail[0] if tail else ""
    return _BREAKS.split(text[: len(text) - len(marks)]), marks.strip(_CLOSERS)


def source_end(marks: str) -> int:
    return _ASKED if marks[-1:] in ("?", "？") else _ENDED if marks[-1:] and marks[-1] in _TERMINAL else _OPEN


def target_end(marks: str) -> int:
    return _NO_MARK if not marks else _GOES_ON if _OPEN_MARK.search(marks) else _ASK_MARK if marks[-1] in "?？" else _STOP_MARK


def measures(source: str, target: str) -> tuple[bool, int, int]:
    """Of a pair, its asides left out: whether the source is Cyrillic, its letters, the target's CJK signs."""
    letters = _NO_LETTERS.sub("", _bare(source))
    return 2 * len(_CYRILLIC_LETTERS.sub("", letters)) < len(letters), len(letters), len(_NO_SIGNS.sub("", _bare(target)))


def states(source: str, target: str) -> tuple[list[tuple[int, str]], int, int]:
    """The target's clauses, each with the state that the source is in there, then how both end.

    A state is the way the source ends and whether it has clauses left after as many as the target has told."""
    own, marks = clauses(source)
    end = source_end(marks)
    told, target_marks = clauses(target)
    return [(2 * end + (len(own) - 1 > k), "".join(c.split())) for k, c in enumerate(told)], end, target_end(target_marks)


def _bucket(a: np.ndarray, b: np.ndarray, state: np.ndarray | int) -> np.ndarray:
    """Cells of two signs (the first 0: of the second alone) in a state."""
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) << np.uint64(21)) | b.astype(np.uint64) | (np.uint64(1) + np.asarray(state, dtype=np.uint64) << np.uint64(43))
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - STOP_BITS)).astype(np.int64)


def _cell(a: int, b: int, state: int) -> int:
    """The same of one pair."""
    return ((((a << 21) | b | (1 + state << 43)) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - STOP_BITS)


def _points(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)


def _twos(ends: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The signs of texts of two."""
    points = _points(ends)
    return (points[1::3], points[2::3]) if ends else (points[:0], points[:0])


_RATIO_BINS = 400  # of a two-hundredth
#: Kinds of counts: two signs or one in a state, and texts that end there; CJK signs by letter of Latin and Cyrillic sources; states; marks at the end; clauses that end there in mid-text.
_PAIR, _LATIN, _CYRILLIC, _STATE, _MARKS, _HALT = range(6)


def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts over all pairs, in cells of fixed number."""
    total, stopped = np.zeros(1 << STOP_BITS, dtype=np.int64), np.zeros(1 << STOP_BITS, dtype=np.int64)
    halted = np.zeros(1 << STOP_BITS, dtype=np.int64)
    ratio, state_n, state_m, marks = np.zeros((3, _RATIO_BINS), dtype=np.int64), np.zeros(6, dtype=np.int64), np.zeros(6, dtype=np.int64), np.zeros(12, dtype=np.int64)
    for pdf in batches:
        pools: list[list[str]] = [[] for _ in range(6)]
        ends: list[list[str]] = [[] for _ in range(6)]
        halts: list[list[str]] = [[] for _ in range(6)]
        for source, target in zip(pdf["source"], pdf["target"], strict=True):
            if not source or target is None:
                continue
            source, target = _uncarried(source), _uncarried(core(target))
            cyrillic, letters, signs = measures(source, target)
            if signs < 2:
                continue
            told, end, mark = states(source, target)
            for state, clause in told:
                pools[state].append(clause)
            for state, clause in told[:-1]:
                if state % 2:
                    halts[state].append(clause[-2:].rjust(2))
            ends[told[-1][0]].append(told[-1][1][-2:].rjust(2))
            marks[4 * end + mark] += 1
            if letters >= 8:
                ratio[1 + cyrillic, min(_RATIO_BINS - 1, 200 * signs // letters)] += 1
        for state in range(6):
            points = _points(pools[state])
            for into, a, b in ((total, points[:-1], points[1:]), (stopped, *_twos(ends[state])), (halted, *_twos(halts[state]))):
                one, two = b > 32, (a > 32) & (b > 32)
                into += np.bincount(_bucket(a[two], b[two], state), minlength=1 << STOP_BITS)
                into += np.bincount(_bucket(np.zeros_like(b[one]), b[one], state), minlength=1 << STOP_BITS)
            state_n[state] += sum(map(len, pools[state]))
            state_m[state] += len(ends[state])
    used = np.flatnonzero(total)
    yield pd.DataFrame({"kind": _PAIR, "key": used, "n": total[used], "m": stopped[used]})
    for kind, n, m in ((_HALT, halted, None), (_LATIN, ratio[1], None), (_CYRILLIC, ratio[2], None), (_STATE, state_n, state_m), (_MARKS, marks, None)):
        used = np.flatnonzero(n)
        yield pd.DataFrame({"kind": kind, "key": used, "n": n[used], "m": 0 if m is None else m[used]})


def length_odds(counts: np.ndarray) -> np.ndarray:
    """Of each bin of signs by letter, the log odds that a whole target has it rather than one cut at any place, from the histogram of all targets."""
    width = np.exp(-0.5 * (np.arange(-24, 25) / 8.0) ** 2)
    whole = np.convolve(counts, width / width.sum(), mode="same") + 1e-3
    cut = np.cumsum((whole / (np.arange(len(counts)) + 0.5))[::-1])[::-1]
    return np.clip(np.log(whole / np.maximum(cut, 1e-9)), -LENGTH_MOST, LENGTH_MOST) if counts.sum() else np.zeros(len(counts))


class PairModel:
    """What the classification needs: the language model, how likely texts end after their last signs, usual target lengths."""

    def __init__(self, languages: LanguageBayes, counts: Sequence[tuple[int, int, int, int]]):
        self.languages = languages
        self.total, self.stopped = array("d", bytes(8 << STOP_BITS)), array("d", bytes(8 << STOP_BITS))
        bins, self.state_n, self.state_m, marks = np.zeros((3, _RATIO_BINS)), np.ones(6), np.zeros(6), np.zeros(12)
        halted = array("d", bytes(8 << STOP_BITS))
        for kind, key, n, m in counts:
            if kind == _HALT:
                halted[key] = n
            elif kind == _PAIR:
                self.total[key], self.stopped[key] = n, m
            elif kind == _STATE:
                self.state_n[key], self.state_m[key] = n, m
            elif kind == _MARKS:
                marks[key] = n
            else:
                bins[kind, key] = n
        # where clauses are left, a cut falls as often on the end of one as on any place
        ends = np.frombuffer(halted)
        self.total = array("d", ((np.frombuffer(self.total) + ends * (self.state_n.sum() / max(1.0, ends.sum() / 2))) / 2).tobytes())
        self.length = [np.zeros(_RATIO_BINS), length_odds(bins[1]), length_odds(bins[2])]
        marks = marks.reshape(3, 4)
        self.marks = np.log((marks + 0.5) / (marks.sum(axis=1, keepdims=True) + 2) * 4).tolist()
        self.rate = max(1.0, self.state_m.sum()) / max(1.0, self.state_n.sum())

    def stop_odds(self, source: str, target: str) -> float:
        """How likely a target ends as this one does: by n-gram counts over all targets, without this one, of its last two signs where the source is
        there, backed off to the last sign and the state, and of the marks after them for how the source ends."""
        told, end, mark = states(source, target)
        state, text = told[-1]
        b = ord(text[-1]) if text else 32
        a = ord(text[-2]) if len(text) > 1 else 32
        p = max(0.0, self.state_m[state] - 1 + self.rate) / max(1.0, self.state_n[state])
        for first in (0, a) if a > 32 else (0,):
            if b > 32:
                k = _cell(first, b, state)
                p = (max(0.0, self.stopped[k] - 1) + BACKOFF * p) / (max(0.0, self.total[k] - 1) + BACKOFF)
        return p * math.exp(self.marks[end][mark])

    def end_likelihood(self, source: str, target: str) -> float:
        """Log likelihood ratio of the target's end against that of a cut at any place."""
        return math.log(max(self.stop_odds(source, target), 1e-9) / self.rate)

    def truncated(self, source: str, target: str) -> bool:
        """Whether the end-of-text likelihood, with the length as prior, speaks for a cut."""
        source = _uncarried(source)
        cyrillic, letters, signs = measures(source, target)
        if letters < 4 or not signs:
            return False
        return WHOLE + self.end_likelihood(source, target) + self.length[1 + cyrillic][min(_RATIO_BINS - 1, 200 * signs // letters)] < 0

    def defects(self, sources: Sequence[str | None], targets: Sequence[str | None], kept: Sequence[bool]) -> list[str | None]:
        """The defect of each pair, if it has one; ``kept`` says which sources are just a term that stays as it is."""
        out: list[str | None] = [None] * len(sources)
        clean = [_uncarried(core(t)) for t in targets]
        letters = [_letters(_without_asides(t)) for t in clean]
        asked, own = self.languages.judged([_letters(_uncarried(s or "")) for s in sources])
        given, declines = self.languages.judged(letters)
        chinese, japanese = (self.languages.languages.index(x) for x in ("zh", "ja"))
        for i, text in enumerate(letters):  # a Japanese sentence has kana
            if not _KANA.search(text):
                given[i, chinese] += given[i, japanese]
                given[i, japanese] = 0
        same = (asked * given).sum(axis=1)
        for i, (source, target) in enumerate(zip(sources, targets, strict=True)):
            whole = core(target)
            if is_empty(whole):
                out[i] = "empty"
                continue
            has_source = source is not None and bool(source.strip())
            foreign = given[i, chinese] < 0.5 and bool(letters[i])
            alike = likeness(_without_asides(source), _without_asides(whole)) if has_source and foreign else 0.0
            if alike >= COPY or (alike >= COPY_SAME and same[i] > 0.5):
                if not kept[i]:
                    out[i] = "copy"
                continue
            if declines[i] >= DECLINES and (not has_source or declines[i] - own[i] >= DECLINES_MORE):
                out[i] = "refusal"
            elif foreign:
                out[i] = "wrong_language"
            elif has_source and self.truncated(source, clean[i]):
                out[i] = "truncated"
        return out


def _without_asides(text: str) -> str:
    """A text without what it has in brackets, unless nothing else is there."""
    bare = _bare(text)
    return bare if bare is text or _LETTERS.search(bare) else text


SCHEMA = "kind int, key bigint, n bigint, m bigint"


def _term(text: Column) -> Column:
    """A text's letters, lower-cased: what it says but for numbers and punctuation."""
    return F.lower(F.regexp_replace(text, r"\P{L}+", ""))


def pair_defects(pairs: DataFrame, languages: LanguageBayes, kept_terms: DataFrame | Sequence[str], *, key: list[str], source: str, target: str, version: str) -> DataFrame:
    """``*key, defect`` for each pair with a defect: empty, copy, refusal, wrong_language or truncated.

    Two passes. The first counts over all pairs, into tables of fixed size, how often targets end after each two
    signs where the source is told or not, with which marks, and how long they are for their sources. The second compares the language posteriors of
    prompt and response, and the likelihood of the response as a refusal with the prompt's; a response in Chinese is truncated if that of its end, by those counts, is too low. Sources that are just a term of ``kept_terms`` (a column ``term``, or a list) are found by a join, whose side Spark
    sends round only if it is small. Only (key, version, defect) is shuffled, to count repeated rows once, by the latest version. Texts are read whole.

    Cases: a null, blank or filler target is 'empty' whatever the source; null or blank sources have no other defect but refusal
    and wrong language; sources that are just a kept term may be repeated; a key with nulls is a key; no rows, no
    defects; further columns are ignored.
    """
    spark = pairs.sparkSession
    texts = pairs.select(*key, F.col(version).alias("_version"), F.col(source).alias("source"), F.col(target).alias("target"))
    counts = texts.select("source", "target").mapInPandas(tally, SCHEMA).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    sums = counts.toArrow()  # cells of fixed number
    model = spark.sparkContext.broadcast(PairModel(languages, list(zip(*(sums.column(c).to_pylist() for c in ("kind", "key", "n", "m")), strict=True))))
    terms = kept_terms if isinstance(kept_terms, DataFrame) else spark.createDataFrame([(t,) for t in kept_terms], "term string")
    terms = terms.select(_term(F.col("term")).alias("_term")).where("_term <> ''").distinct().withColumn("_kept", F.lit(True))
    marked = texts.withColumn("_term", _term(F.col("source"))).join(terms, "_term", "left").select(*texts.columns, F.coalesce("_kept", F.lit(False)).alias("_kept"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for at in range(0, len(pdf), 2000):
                found += model.value.defects(*(pdf[c].iloc[at : at + 2000].tolist() for c in ("source", "target", "_kept")))
            yield pdf.drop(columns=["source", "target", "_kept"]).assign(defect=[d or "" for d in found])

    types = {f.name: f.dataType.simpleString() for f in texts.schema}
    flagged = marked.mapInPandas(work, ", ".join([*(f"{k} {types[k]}" for k in key), f"_version {types['_version']}", "defect string"]))
    latest = flagged.groupBy(*key).agg(F.max(F.struct("_version", "defect")).alias("_x"))
    return latest.where("_x.defect <> ''").select(*key, F.col("_x.defect").alias("defect"))
