"""Mapping freely typed values to the entries of reference lists by token repair and soft TF-IDF."""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspan.runtime import cut_lineage

UNMATCHED = "(unmatched)"
#: Letters from which tokens meet by segments in place of deletions, of which they would have too many.
LONG = 48
#: Soft TF-IDF from which a spelling of three tokens or more may lack one.
LACKING = 0.75

# Words that may stand around a name without being part of it.
AROUND = frozenset("a album an band by clip dr el feat featuring film ft group intro la late le live mr mrs ms movie of official ost outro s series sic singer song soundtrack that the thing track tv".split())
# Cyrillic letters in Latin spelling, as names are romanised.
_LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяєіїґ", "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch - y - e yu ya e i i g".replace("-", "").split(" "), strict=True))
_CAMEL = re.compile(r"(?<=[a-zа-яё])(?=[A-ZА-ЯЁ])")
_SIGNS = "぀-ヿ㐀-鿿"


def tokens(value: str | None) -> list[str]:
    """Words of a typed value: width, case, accents and punctuation aside, possessive dropped, joined capitalised
    words parted, Cyrillic romanised, runs of CJK signs whole, blanks and dots between them aside."""
    if not value:
        return []
    text = unicodedata.normalize("NFKC", value)
    text = re.sub(r"['’`´]s\b", "", text)
    if not re.search(r"\b[a-z][A-Z]", text):  # inverted case is no joint
        text = _CAMEL.sub(" ", text)
    text = "".join(_LATIN.get(c, c) for c in unicodedata.normalize("NFC", text).lower())
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = unicodedata.normalize("NFKC", text)
    text = re.sub(rf"(?<=[{_SIGNS}])[\s·・.\-]+(?=[{_SIGNS}])", "", text)
    return re.findall(rf"[{_SIGNS}]+|[^\W_{_SIGNS}]+", text.replace("'", "").replace("’", ""))


def edits(a: str, b: str) -> int:
    """Edit distance in which swapping two neighbours costs one."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
    return row[-1]


def _is_signs(token: str) -> bool:
    return bool(re.match(f"[{_SIGNS}]", token))


def deletions(token: str) -> list[str]:
    """The token with up to as many letters deleted as it may have edits: two tokens within that distance share one."""
    most = (1 if len(token) >= 4 else 0) if _is_signs(token) else 2 if len(token) >= 4 else 1 if len(token) == 3 else 0
    out = {token}
    for k in range(1, most + 1):
        out |= {"".join(c for i, c in enumerate(token) if i not in drop) for drop in map(set, combinations(range(len(token)), k))}
    return sorted(out)


def segments(token: str, *, own: bool) -> list[str]:
    """Fifths of a long token with their length and place: two edits touch four fifths at most, a swap two of them, so one stays whole.

    Of a reference (``own``) its own fifths; of a typed token whatever may be a fifth of a reference within two edits: of any length
    near its own, moved by two letters at most."""
    out = set()
    for size in (len(token),) if own else range(len(token) - 2, len(token) + 3):
        ends = [size * k // 5 for k in range(6)]
        for k in range(5):
            for at in (ends[k],) if own else range(max(0, ends[k] - 2), ends[k] + 3):
                out.add(f"{size} {k} {token[at : at + ends[k + 1] - ends[k]]}")
    return sorted(out)


def meeting_keys(token: str, *, own: bool) -> list[str]:
    """Keys of which a typed token and one of a reference within two edits share one, whatever their length."""
    return (deletions(token) if len(token) <= LONG else []) + (segments(token, own=own) if len(token) >= LONG - 1 else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(values: pd.Series) -> pd.Series:
    return values.map(tokens)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _typed_keys(values: pd.Series) -> pd.Series:
    return values.map(lambda t: meeting_keys(t, own=False))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _own_keys(values: pd.Series) -> pd.Series:
    return values.map(lambda t: meeting_keys(t, own=True))


@F.pandas_udf(T.IntegerType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edits(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def forms(value: str | None, person: bool) -> list[list[str]]:
    """Token bags by which an entry's spelling may be meant: all words, all joined, and of a person's two words
    the last alone and with the first's initial."""
    words = [w for w in tokens(value) if w not in AROUND] or tokens(value)
    if not words:
        return []
    out = [words]
    if len(words) > 1:
        out.append(["".join(words)])
    if person and len(words) == 2 and len(words[1]) >= 4:
        out.append([words[1]])
        if not _is_signs(words[0]):
            out.append([words[0][0], words[1]])
    return out


def map_terms(entries: DataFrame, references: DataFrame, *, entry_id: str = "entry_id", kind: str = "list_kind", value: str = "surface_form", person_kinds: tuple[str, ...] = ("entity",)) -> DataFrame:
    """``entry_id, canonical, score, n_edits``: the reference entry that each typed value means, or ``'(unmatched)'``.

    ``references``: ``list_kind, canonical, form``, a row for each spelling. Each different token of the
    typed values is joined to the tokens of its list by edit distance: both sides are spelled out with up to
    two letters deleted (long ones in fifths), joined on those keys and verified exactly, so no token is held against the whole
    vocabulary. A value meets a spelling through one of the spelling's two rarest tokens, so a word that many spellings
    and values share multiplies nothing.

    Admitted is a spelling whose tokens are all covered by tokens of the value, of three or more all but one if its soft TF-IDF is ``LACKING`` or
    more, and whose edits together stay within its length's room (two from eight letters, one from five); one of a single token must also be all that the
    value says, but for words such as "the" or "feat.". The admitted are ranked by soft TF-IDF, rounded to a millionth: the sum over covered tokens of
    both sides' normalised IDF weights and their similarity. A value's token weighs as the token that it is repaired to; one that is like none weighs
    as a token that a single entry has, words that may stand around a name nothing. Ties go to fewer edits, then more tokens, then the first name; if only a last
    name fits and it fits several entries alike, none is taken. Each different value is treated once, so a value typed a billion times costs one row.

    Cases: null and blank values give no row; values without letters are unmatched; blank or null spellings and
    entries don't count; no references: all unmatched; repeated rows and null ids are kept.
    """
    typed = entries.select(F.col(entry_id).alias("_id"), F.col(kind).alias("_kind"), F.col(value).alias("_value")).where(F.length(F.regexp_replace("_value", r"[\s\p{Z}]+", "")) > 0)
    values = typed.select("_kind", "_value").distinct().withColumn("_t", F.array_distinct(_tokens("_value"))).withColumn("_v", F.xxhash64("_kind", "_value"))
    values = cut_lineage(values)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def spelled(value: pd.Series, person: pd.Series) -> pd.Series:
        return pd.Series([forms(v, p) for v, p in zip(value, person, strict=True)])

    named = references.select(F.col(kind).alias("_kind"), "canonical", "form").where("canonical IS NOT NULL AND form IS NOT NULL").distinct()
    spellings = named.withColumn("_f", F.explode(spelled("form", F.col("_kind").isin(*person_kinds)))).select("_kind", "canonical", F.array_sort(F.array_distinct("_f")).alias("_f")).distinct()
    spellings = cut_lineage(spellings.withColumn("_form", F.xxhash64("_kind", "canonical", "_f")))
    tokens_of = spellings.select("_kind", "canonical", "_form", F.explode("_f").alias("_ref"))
    df = tokens_of.groupBy("_kind", "_ref").agg(F.countDistinct("canonical").alias("_df"))
    whole = spellings.groupBy("_kind").agg(F.countDistinct("canonical").alias("_all"))
    vocabulary = cut_lineage(df.join(whole, "_kind").select("_kind", "_ref", F.log1p(F.col("_all") / F.col("_df")).alias("_idf"), F.log1p(F.col("_all").cast("double")).alias("_most")))
    weighed = tokens_of.join(vocabulary, ["_kind", "_ref"]).groupBy("_kind", "canonical", "_form").agg(F.array_sort(F.collect_list(F.struct((-F.col("_idf")).alias("minus"), F.col("_ref").alias("ref")))).alias("_w"), F.first("_most").alias("_most"))
    posting = weighed.withColumn("_ref", F.explode(F.transform(F.slice("_w", 1, F.when(F.size("_w") > 2, 2).otherwise(1)), lambda x: x.ref)))

    used = values.select("_kind", F.explode("_t").alias("_token")).distinct()
    near = (
        used.withColumn("_key", F.explode(_typed_keys("_token")))
        .join(vocabulary.select("_kind", "_ref", "_idf").withColumn("_key", F.explode(_own_keys("_ref"))), ["_kind", "_key"])
        .select("_kind", "_token", "_ref", "_idf").distinct()
        .where(F.levenshtein("_token", "_ref", 4) >= 0)  # a swap counts two there
        .withColumn("_edits", _edits("_token", "_ref"))
        .where((F.col("_edits") == 0) | ((F.col("_edits") <= 2) & (F.length("_ref") > 2) & (F.length("_token") > 2)))
    )
    repaired = cut_lineage(near.withColumn("_sim", 1 - F.col("_edits") / F.greatest(F.length("_token"), F.length("_ref"))))
    said = values.select("_v", "_kind", F.explode("_t").alias("token")).join(repaired.withColumnRenamed("_token", "token"), ["_kind", "token"])
    one = F.struct("_edits", (-F.col("_sim")).alias("_minus"), "token", F.col("_ref").alias("ref"), F.col("_idf").alias("idf"))
    bags = said.groupBy("_kind", "_v").agg(F.collect_list(one).alias("_r"))
    met = said.select("_kind", "_v", "_ref").distinct().join(posting, ["_kind", "_ref"]).select("_kind", "_v", "canonical", "_form", "_w", "_most").distinct()
    around = F.array(*[F.lit(w) for w in sorted(AROUND)])
    hits = met.join(bags, ["_kind", "_v"]).join(values.select("_v", "_t"), "_v")
    best = lambda ref: F.array_min(F.filter("_r", lambda r: r.ref == ref))
    hits = hits.withColumn("_c", F.filter(F.transform("_w", lambda x: best(x.ref)), lambda r: r.isNotNull()))
    hits = hits.withColumns({
        "_n": F.size("_w"), "_covered": F.size("_c"), "_used": F.array_distinct(F.transform("_c", lambda r: r.token)), "_letters": F.length(F.array_join(F.transform("_w", lambda x: x.ref), "")),
        "_signs": F.exists("_w", lambda x: x.ref.rlike(f"^[{_SIGNS}]")), "n_edits": F.aggregate("_c", F.lit(0), lambda a, r: a + r["_edits"]),
    })
    # a value's token weighs as what it is repaired to here, else as what it is nearest to, else as a token of one entry
    weight = lambda t: F.when(F.array_contains("_used", t), F.try_element_at(F.transform(F.filter("_c", lambda r: r.token == t), lambda r: r.idf), F.lit(1))).when(F.array_contains(around, t), F.lit(0.0)).otherwise(F.coalesce(F.try_element_at(F.transform(F.array_sort(F.filter("_r", lambda r: r.token == t)), lambda r: r.idf), F.lit(1)), F.col("_most")))
    square = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
    shared = F.aggregate("_c", F.lit(0.0), lambda a, r: a - r["_minus"] * r.idf * r.idf)
    norms = F.sqrt(square(F.transform("_t", weight)) * square(F.transform("_w", lambda x: x.minus)))
    hits = hits.withColumn("score", F.round(F.when(norms > 0, shared / norms).otherwise(0.0), 6))
    allowed = F.when(F.col("_signs"), F.when(F.col("_letters") >= 4, 1).otherwise(0)).otherwise(F.when(F.col("_letters") >= 8, 2).when(F.col("_letters") >= 5, 1).otherwise(0))
    left = F.array_except(F.array_except("_t", "_used"), around)
    enough = (F.col("_covered") == F.col("_n")) | ((F.col("_n") > 2) & (F.col("_covered") == F.col("_n") - 1) & (F.col("score") >= LACKING))
    full = hits.where(enough & (F.size("_used") == F.col("_covered")) & (F.col("n_edits") <= allowed) & ((F.col("_n") > 1) | (F.size(left) == 0)))
    order = [F.desc("score"), F.col("n_edits"), F.desc("_n")]
    ranked = full.groupBy("_v", "canonical").agg(F.min(F.struct((-F.col("score")).alias("_minus_s"), "n_edits", (-F.col("_n")).alias("_minus_n"))).alias("_x"))
    ranked = ranked.select("_v", "canonical", "_x.n_edits", (-F.col("_x._minus_n")).alias("_n"), (-F.col("_x._minus_s")).alias("score"))
    by = Window.partitionBy("_v").orderBy(*order, "canonical")
    best = ranked.withColumn("_rank", F.row_number().over(by)).withColumn("_next", F.lead(F.struct("score", "n_edits", "_n")).over(by)).where("_rank = 1")
    best = best.where(~((F.col("_n") == 1) & F.col("_next").isNotNull() & (F.col("_next.score") == F.col("score")) & (F.col("_next.n_edits") == F.col("n_edits")) & (F.col("_next._n") == 1)))
    mapped = values.select("_kind", "_value", "_v").join(best.select("_v", "canonical", "score", "n_edits"), "_v", "left").drop("_v")
    same: Column = typed["_kind"].eqNullSafe(mapped["_kind"]) & (typed["_value"] == mapped["_value"])
    return typed.join(mapped, same, "left").select(F.col("_id").alias(entry_id), F.coalesce("canonical", F.lit(UNMATCHED)).alias("canonical"), "score", "n_edits")
