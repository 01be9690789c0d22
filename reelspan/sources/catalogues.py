"""Readers of glossaries, entity registries, profiles, evidence and search results; schemas are declared, odd records left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.functions import rules as R
from reelspan.functions.wording import strip_markup

TERM = "struct<canonical:string,type:string,aliases:array<string>,bad_aliases:array<string>,zh:string,policy:string,confidence:double,priority:string,short_name:string,sources:array<string>>"
ENTITY = "struct<key:string,entity_type:string,canonical_en:string,canonical_native:string,canonical_zh:string,surface_forms:array<string>,short_zh:string,mention_strategy:string,policy:string,confidence:double>"
EVIDENCE = "struct<source:string,title:string,url:string,summary:string,fetched_at:string,confidence:string,project_id:string,input_fingerprint:string,evidence_level:string,schema_version:int>"
CANDIDATE = "struct<title:string,bvid:string,author:string,duration:string,pubdate:bigint,description:string>"


def documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, value`` of whole files."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")


def _rows(docs: DataFrame, field: str, kind: str) -> DataFrame:
    """The records under a field of JSON documents, with the other columns; none of a document that has no such field or is no JSON."""
    found = F.from_json("value", f"struct<{field}:array<{kind}>>")[field]
    return docs.select(*[c for c in docs.columns if c != "value"], F.explode(found).alias("_r")).select(*[c for c in docs.columns if c != "value"], "_r.*")


def glossary_terms(docs: DataFrame) -> DataFrame:
    """Terms of JSON glossaries (``value``): those with a name, folded; lists without blanks; policy 'preserve' and the name as Chinese form where none is given."""
    tidy = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: R.squash(x)), lambda x: x != "")
    rows = _rows(docs, "terms", TERM).withColumn("canonical", R.squash(F.col("canonical"))).where("canonical <> ''")
    return rows.withColumns({
        "zh": F.when(F.trim("zh") != "", F.trim("zh")).otherwise(F.col("canonical")), "policy": F.when(F.trim("policy") != "", F.lower(F.trim("policy"))).otherwise("preserve"),
        "aliases": tidy(F.col("aliases")), "bad_aliases": tidy(F.col("bad_aliases")), "confidence": F.coalesce("confidence", F.lit(0.0)),
    })


def entity_rules(docs: DataFrame) -> DataFrame:
    """Entities of JSON registries, each key once in a document: the one of highest confidence, then least by name."""
    rows = _rows(docs, "entities", ENTITY).where(F.trim("canonical_en") != "").withColumn("key", F.coalesce("key", R.squash(F.lower("canonical_en"))))
    keep = [c for c in docs.columns if c != "value"]
    rest = [c for c in rows.columns if c not in (*keep, "key")]
    best = rows.groupBy(*keep, "key").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("confidence", F.lit(0.0)), "canonical_en")).alias("_x"))
    return best.select(*keep, "key", "_x.*")


def evidence(docs: DataFrame, *, versions: tuple[int, ...] = (1,), levels: tuple[str, ...] = ("confirmed", "advisory", "unknown")) -> DataFrame:
    """Evidence records of JSONL lines (``value``) that hold: a known version and level, a source, any of title, address and summary, an address that is one if there is one, and a confidence from 0 to 1 or 'unknown' (null here)."""
    rows = docs.select(*[c for c in docs.columns if c != "value"], F.from_json("value", EVIDENCE).alias("_r")).select(*[c for c in docs.columns if c != "value"], "_r.*")
    number = F.col("confidence").try_cast("double")
    said = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    ok = F.col("schema_version").isin(*versions) & F.col("evidence_level").isin(*levels) & said("source") & (said("title") | said("url") | said("summary")) & (~said("url") | F.coalesce(F.col("url"), F.lit("")).rlike(r"^https?://[^\s/]+"))
    return rows.where(ok & ((F.lower("confidence") == "unknown") | number.between(0, 1))).withColumn("confidence", number)


def search_evidence(rows: DataFrame, keywords: list[str], project: str) -> DataFrame:
    """A project's evidence that holds every keyword in its title or summary, case aside; no keywords, no rows."""
    words = [w.strip().lower() for w in keywords if w.strip()]
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    wanted = F.lit(bool(words))
    for w in words:
        wanted = wanted & F.contains(text, F.lit(w))
    return rows.where(wanted & ((F.col("project_id") == project) | F.col("project_id").isNull()))


def api_candidates(docs: DataFrame) -> DataFrame:
    """Candidates of a search interface's answers: title without markup, id, author, seconds, date, description. Answers of another form give none."""
    found = F.coalesce(F.from_json("value", f"struct<data:struct<result:array<{CANDIDATE}>>>")["data"]["result"], F.from_json("value", f"struct<result:array<{CANDIDATE}>>")["result"])
    keep = [c for c in docs.columns if c != "value"]
    rows = docs.select(*keep, F.explode(found).alias("_r")).select(*keep, "_r.*").where("bvid rlike '^BV[0-9A-Za-z]+$'")
    return rows.select(*keep, "bvid", strip_markup(F.col("title")).alias("title"), F.trim("author").alias("author"), (R.parse_clock(F.col("duration")) / 1000).alias("duration_s"), F.timestamp_seconds("pubdate").alias("published_at"), strip_markup(F.col("description")).alias("description"))


def page_candidates(docs: DataFrame) -> DataFrame:
    """``bvid, title`` of the links to videos in pages, each id once: its first title."""
    keep = [c for c in docs.columns if c != "value"]
    links = docs.select(*keep, F.posexplode(F.regexp_extract_all("value", F.lit(r'(?s)(<a\b[^>]*/video/BV[0-9A-Za-z]+[^>]*>.*?</a>)'), 1)).alias("_k", "_a"))
    title: Column = F.coalesce(F.nullif(strip_markup(F.regexp_extract("_a", r'title="([^"]*)"', 1)), F.lit("")), strip_markup(F.col("_a")))
    rows = links.select(*keep, "_k", F.regexp_extract("_a", "/video/(BV[0-9A-Za-z]+)", 1).alias("bvid"), title.alias("title")).where("title <> ''")
    return rows.groupBy(*keep, "bvid").agg(F.min_by("title", "_k").alias("title"))
