"""Language labels in any spelling, and samples of labelled documents to fit models on."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGUAGES = ("de", "en", "es", "fr", "ja", "ru", "uk", "zh")
#: Labelled documents, by hash of their id, on which a language model is fitted at most.
SAMPLE_DOCS = 2000
#: Characters of each that a model is fitted on at most.
SAMPLE_CHARS = 4000

# Codes, and names of the languages in English and in the eight languages.
NAMES = {
    "de": "de deu ger german deutsch alemán allemand ドイツ語 немецкий німецька 德语 德文 de-at",
    "en": "en eng english englisch inglés anglais 英語 английский англійська 英语 英文",
    "es": "es spa spanish spanisch español castellano espagnol スペイン語 испанский іспанська 西班牙语 西班牙文",
    "fr": "fr fra fre french französisch francés français フランス語 французский французька 法语 法文",
    "ja": "ja jpn jp japanese japanisch japonés japonais 日本語 日语 日文 японский японська",
    "ru": "ru rus russian russisch ruso russe ロシア語 русский російська 俄语 俄文",
    "uk": "uk ukr ua ukrainian ukrainisch ucraniano ukrainien ウクライナ語 украинский українська 乌克兰语 乌克兰文",
    "zh": "zh zho chi cmn cn chinese mandarin chinesisch chino chinois 中国語 中文 汉语 漢語 中文简体 китайский китайська hans hant",
}


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


_BY_NAME = {_plain(n): lang for lang, names in NAMES.items() for n in names.split()}


@lru_cache(maxsize=4096)
def label_language(label: str | None) -> str | None:
    """The language that a label names by code, region, script or name, in any spelling; None for none of the eight."""
    if label is None:
        return None
    words = re.findall(r"[^\W\d_]+", _plain(label))
    return next((_BY_NAME[w] for w in words if w in _BY_NAME), None)


@F.pandas_udf(T.StringType())
def _named(labels: pd.Series) -> pd.Series:
    return labels.map({x: label_language(x) for x in labels.dropna().unique()}).astype(object)


def labelled_sample(docs: DataFrame, *, docs_at_most: int = SAMPLE_DOCS, chars_at_most: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(language, text) of up to ``docs_at_most`` documents with a label that names a language, least by hash of the id; of each as much as fits a model on.

    Only this sample to fit on is bounded; what the model is applied to is read whole."""
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 20)).select(_named("lang").alias("lang"), F.substring("text", 1, chars_at_most).alias("text"), F.xxhash64("doc_id").alias("h")).where("lang IS NOT NULL")
    return [(r[0], r[1]) for r in rows.orderBy("h").limit(docs_at_most).select("lang", "text").collect()]
