"""Languages of documents and of their lines by hyperdimensional n-gram profiles."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.labels import LANGUAGES, label_language

#: Bits of a vector, as 64-bit words.
WORDS = 32
DIM = 64 * WORDS
ORDERS = (1, 2, 3, 4)
#: How much nearer (in cosine) another language than the document's must be for a line to have it.
MARGIN = 0.035
#: Scale that turns cosines into a confidence.
SHARPNESS = 40.0
_CHUNK = 1000
#: Bits of a mixed n-gram key; the rest of a 64-bit word says which line it is of.
_KEY_BITS = 44

_LINK = re.compile(r"https?://\S+|www\.\S+|[^\s@]{1,64}@[^\s@]{1,250}|[#@][^\s#]+")
_EVENT = re.compile(r"^\s*Dialogue:\s*(?:[^,]*,){9}")
_MARKUP = re.compile(r"\{[^}]*\}|<[^>]*>|\\[Nnh]|&\w+;")
_QUOTED = re.compile(r"\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]|【[^】]*】|“[^“”]*”|«[^«»]*»|„[^„“”]*[“”]|「[^「」]*」|『[^『』]*』|\"[^\"]*\"")
_CODE = re.compile(r"\d[\d:.,]*")
_OTHER = re.compile(r"[\W\d_]+")
_END = re.compile(r"[.!?…。！？]")
_LETTER = re.compile(r"[^\W\d_]")
_SIGNS = re.compile(r"[{<\\&@#(（\[【“«„「『\"]|://|www|Dialogue:")
_SIGN_NAME = re.compile(r"\s*[぀-ヿ㐀-鿿]{1,8}(?:[·・ ][぀-ヿ㐀-鿿]{1,8}){1,2}\s*")
_BREAK = re.compile(r"\r\n|\r|\n")


def sentence_text(line: str) -> str:
    """What of a line can show its language: without event fields, links, tags, markup, time codes, quoted
    phrases (unless nothing else is there) and lone names; lower-cased letters with single spaces."""
    signs = _SIGNS.findall(line)
    if signs:  # most lines have none of what the patterns look for
        line = _MARKUP.sub(" ", _LINK.sub(" ", _EVENT.sub("", line)))
    bare = _QUOTED.sub(" ", line) if signs else line
    if bare is not line and not _LETTER.search(bare):
        bare = line
    words = _OTHER.sub(" ", bare).split()
    if len(words) <= 3 and words and not _END.search(_CODE.sub(" ", bare)):
        if all(w[0].isupper() for w in words) or _SIGN_NAME.fullmatch(bare):
            return ""  # a name
    return " ".join(words).lower()


# Romanisation of Cyrillic letters, for texts written without them.
_ROMAN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch - y - e yu ya".replace("-", "").split(" "), strict=True))
_ROMAN_UK = _ROMAN | {"г": "h", "ґ": "g", "є": "ye", "и": "y", "і": "i", "ї": "yi"}
#: Spellings that have a prototype of their own: (language, how a line becomes one of them).
SPELLINGS = {
    "ru-latin": ("ru", lambda t: "".join(_ROMAN.get(c, c) for c in t)),
    "uk-latin": ("uk", lambda t: "".join(_ROMAN_UK.get(c, c) for c in t)),
    "de-bare": ("de", lambda t: _bare(t)), "es-bare": ("es", lambda t: _bare(t)), "fr-bare": ("fr", lambda t: _bare(t)),
}


def _bare(text: str) -> str:
    """Without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit words (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """Random binary vectors of letters, the same everywhere: bits hashed from code point and place."""
    place = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        return _mix(letters.astype(np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93) + place[None, :])


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """±1 vectors of n-grams (rows of up to four code points, 0 before shorter ones): the letters' vectors,
    each permuted (rotated) by its place in the n-gram, bound by exclusive or."""
    bound = np.zeros((len(grams), WORDS), dtype=np.uint64)
    width = grams.shape[1]
    for k in range(width):
        used = grams[:, k] > 0
        letters, at = np.unique(grams[used, k], return_inverse=True)
        bound[used] ^= np.roll(letter_vectors(letters), width - 1 - k, axis=1)[at]
    return np.unpackbits(bound.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def _keys(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of the texts as 64-bit keys of 16 bits a letter, and the text of each."""
    joined = " " + "  ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64) & np.uint64(0xFFFF)
    lengths = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    keys, of = [], []
    key = np.zeros(len(points), dtype=np.uint64)
    for n in range(max(ORDERS)):
        size = len(points) - n
        key = (key[:size] << np.uint64(16)) | points[n:]
        if n + 1 in ORDERS:
            inside = owner[:size] == owner[n : n + size]
            if n == 0:
                inside = inside & (points >= 0x3040)  # single letters of an alphabet say little
            keys.append(key[inside])
            of.append(owner[:size][inside])
    return np.concatenate(keys), np.concatenate(of)


def _grams(keys: np.ndarray) -> np.ndarray:
    low = np.uint64(0xFFFF)
    return np.stack([(keys >> np.uint64(16 * k)) & low for k in (3, 2, 1, 0)], axis=1)


class Profiles:
    """Language prototypes, and cosines of texts with them.

    A text's vector is the bundle (sum) of its n-gram vectors. The dot product with a prototype is then the sum
    over n-grams, so that of each n-gram in the prototypes is found once, when they are made. The vectors of other n-grams are
    orthogonal to them but for noise, so those only add to the length. The bundle's length is that of
    its counts, as n-gram vectors are all but orthogonal. A language may have several prototypes, one for each
    spelling; the nearest counts.
    """

    def __init__(self, prototypes: np.ndarray, grams: np.ndarray, of: Sequence[str], languages: Sequence[str] = LANGUAGES):
        self.languages, self.of = tuple(languages), tuple(of)
        centred = prototypes - prototypes.mean(axis=0)
        centred = (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.grams = _mixed(grams).astype(np.int64)
        self.scores = np.concatenate([np.zeros((len(self.of), 0), dtype=np.float32), *(centred @ gram_vectors(_grams(grams[i : i + 2048])).T for i in range(0, len(grams), 2048))], axis=1)
        self._index: pd.Index | None = None

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "of": self.of, "grams": self.grams, "scores": self.scores}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._index = None

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """Places of n-grams among the scores, -1 for those in no prototype."""
        if self._index is None:
            self.grams, kept = np.unique(self.grams, return_index=True)
            self.scores = np.ascontiguousarray(self.scores[:, kept])
            self._index = pd.Index(self.grams)
        return self._index.get_indexer(keys)

    def all_cosines(self, texts: Sequence[str]) -> np.ndarray:
        """A row for each text, a column for each prototype; zeros for texts without letters."""
        out = np.zeros((len(texts), len(self.of)), dtype=np.float64)
        if not len(texts):
            return out
        keys, of = _keys(texts)
        if not len(keys):
            return out
        held = np.sort((of.astype(np.uint64) << np.uint64(_KEY_BITS)) | _mixed(keys))
        first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        counts = np.diff(np.r_[first, len(held)]).astype(np.float32)
        row = (held[first] >> np.uint64(_KEY_BITS)).astype(np.int64)
        at = self._found((held[first] & np.uint64((1 << _KEY_BITS) - 1)).astype(np.int64))
        length = np.bincount(row, weights=counts**2, minlength=len(texts))
        known = np.flatnonzero(at >= 0)
        if len(known):
            row = row[known]
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            gram, weight, row = at[known], counts[known], row[starts]
            for k, column in enumerate(self.scores):
                out[row, k] = np.add.reduceat(column[gram] * weight, starts)
        return out / np.sqrt(np.maximum(length, 1) * DIM)[:, None]

    def cosines(self, texts: Sequence[str]) -> np.ndarray:
        """A row for each text, a column for each language: the cosine with its nearest prototype. Equal texts are compared once."""
        place = {t: k for k, t in enumerate(dict.fromkeys(texts))}
        different = list(place)
        every = np.concatenate([np.zeros((0, len(self.of))), *(self.all_cosines(part) for part in _parts(different))])
        best = np.stack([every[:, [k for k, x in enumerate(self.of) if x == lang]].max(axis=1) if lang in self.of else np.full(len(different), -1.0) for lang in self.languages], axis=1)
        return best[np.fromiter((place[t] for t in texts), dtype=np.int64, count=len(texts))]


def _mixed(keys: np.ndarray) -> np.ndarray:
    """n-gram keys mixed into fewer bits."""
    with np.errstate(over="ignore"):
        return _mix(keys) >> np.uint64(64 - _KEY_BITS)


def _parts(texts: list[str], letters: int = 400_000) -> Iterator[list[str]]:
    """Texts in lists of about so many letters, so that arrays stay small."""
    part: list[str] = []
    size = 0
    for t in texts:
        if part and size + len(t) > letters:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def fit_profiles(sample: Sequence[tuple[str, str]], *, rounds: int = 2, languages: Sequence[str] = LANGUAGES) -> Profiles:
    """Prototypes from labelled texts (a bounded sample): the bundle of the n-gram vectors of each spelling's
    lines, with the root of relative counts. Romanised and bare spellings are made from the lines. Labels may be
    wrong and texts mixed: after the first round, a line goes to the prototype it is nearest to if that
    is clearly nearer than its label's."""
    lines = [(lang, t) for lang, text in sample if lang in languages for line in text.split("\n") if len(t := sentence_text(line)) > 3]
    if not lines:
        raise ValueError("no labelled text to fit languages on")
    names = [lang for lang in languages if any(x == lang for x, _ in lines)]
    names += [k for k, (lang, _) in SPELLINGS.items() if lang in names]
    base = [SPELLINGS[k][0] if k in SPELLINGS else k for k in names]
    own = [(names.index(lang), t) for lang, t in lines]
    own = [(names.index(f"{names[k]}-latin"), t) if names[k] in ("ru", "uk") and re.search("[a-z]", t) and not re.search("[а-я]", t) else (k, t) for k, t in own]
    for step in range(rounds):
        tally: dict[str, list[np.ndarray]] = {"label": [], "key": [], "n": []}
        for at in range(0, len(own), _CHUNK):
            part = own[at : at + _CHUNK]
            part = part + [(names.index(s), f(t)) for s, (lang, f) in SPELLINGS.items() if lang in names for k, t in part if names[k] == lang]
            keys, of = _keys([t for _, t in part])
            label = np.array([k for k, _ in part])[of]
            for k in np.unique(label):
                key, n = np.unique(keys[label == k], return_counts=True)
                tally["label"].append(np.full(len(key), k))
                tally["key"].append(key)
                tally["n"].append(n)
        different, at = np.unique(np.concatenate(tally["key"]), return_inverse=True)
        counts = np.bincount(np.concatenate(tally["label"]) * len(different) + at, weights=np.concatenate(tally["n"]), minlength=len(names) * len(different)).reshape(len(names), len(different))
        profiles = Profiles(_bundle(np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)), different), different, base, languages)
        if step == rounds - 1:
            break
        for at in range(0, len(own), _CHUNK):
            cos = profiles.all_cosines([t for _, t in own[at : at + _CHUNK]])
            own[at : at + _CHUNK] = [(int(c.argmax()) if c.max() - c[k] > 0.05 else k, t) for (k, t), c in zip(own[at : at + _CHUNK], cos, strict=True)]
    return profiles


def _bundle(weights: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Weighted sums of n-gram vectors, of length 1."""
    out = np.zeros((len(weights), DIM), dtype=np.float32)
    for i in range(0, len(grams), 2048):
        out += weights[:, i : i + 2048].astype(np.float32) @ gram_vectors(_grams(grams[i : i + 2048]))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def document_languages(profiles: Profiles, texts: Sequence[str | None], margin: float = MARGIN) -> list[list[tuple[int, str, float]]]:
    """Of each text (line number, language, confidence): line 0 for the main language, that of most lines (then of most
    letters), and each line that has a language. No text or no sentence in it: nothing.

    A line has the nearest language if that is nearer by ``margin`` than the main one, else the main one;
    the confidence is the share of its language when cosines are sharpened and normalised.
    """
    lines = [(d, n, s) for d, text in enumerate(texts) if text for n, line in enumerate(_BREAK.split(text), 1) if (s := sentence_text(line))]
    out: list[list[tuple[int, str, float]]] = [[] for _ in texts]
    if not lines:
        return out
    cos = profiles.cosines([s for _, _, s in lines])
    share = np.exp(SHARPNESS * (cos - cos.max(axis=1, keepdims=True)))
    share /= share.sum(axis=1, keepdims=True)
    doc = np.array([d for d, _, _ in lines])
    size = np.array([len(s) for _, _, s in lines], dtype=float)
    best = cos.argmax(axis=1)
    # Votes of lines, ties by letters and then in the order of the languages.
    votes = np.zeros((len(texts), len(profiles.languages)))
    np.add.at(votes, (doc, best), 1 + size / (1e4 + size.sum()))
    main = votes.argmax(axis=1)
    row = np.arange(len(lines))
    found = np.where(cos[row, best] - cos[row, main[doc]] > margin, best, main[doc])
    votes[:] = 0
    np.add.at(votes, (doc, found), 1 + size / (1e4 + size.sum()))
    main = votes.argmax(axis=1)
    sure = share[row, found]
    mine = found == main[doc]
    total = np.bincount(doc[mine], weights=sure[mine], minlength=len(texts)) / np.maximum(np.bincount(doc[mine], minlength=len(texts)), 1)
    for (d, n, _), f, c in zip(lines, found, sure, strict=True):
        if not out[d]:
            out[d].append((0, profiles.languages[main[d]], float(total[d])))
        out[d].append((n, profiles.languages[f], float(c)))
    return out


SCHEMA = "doc_id bigint, line_no int, lang string, confidence double"


def label_documents(docs: DataFrame, profiles: Profiles, *, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``doc_id, line_no, lang, confidence``: line 0 for documents whose label is missing or names another
    language than the main one, and every line that has a language of documents in two languages or more.

    One pass without a shuffle; the model (the scores of the n-grams of a bounded sample) is broadcast once. Each text is read whole.

    Cases: null and blank texts and texts without a sentence (only names, links, tags, time codes) give no rows; labels
    count in any spelling, unknown ones as missing; rows of one id each give their rows; a null id is kept.
    """

    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                pdf, rows = batch.iloc[at : at + 2000], []
                for key, given, found in zip(pdf["_id"], pdf["_label"], document_languages(sent.value, pdf["_text"].tolist()), strict=True):
                    if found and label_language(given) != found[0][1]:
                        rows.append((key, *found[0]))
                    if len({lang for n, lang, _ in found if n}) > 1:
                        rows += [(key, *f) for f in found[1:]]
                yield pd.DataFrame(rows, columns=["doc_id", "line_no", "lang", "confidence"]).astype({"doc_id": "Int64"})

    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).alias("_label"), F.col(text).alias("_text"))
    return rows.mapInPandas(work, SCHEMA)
