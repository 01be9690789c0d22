"""Queries of the corpus operators over the tables of a data folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.functions.text import BLANK, fold, name_key
from reelspan.llm.alignment import align_sentences
from reelspan.llm.groups import assign_splits, connected_groups
from reelspan.llm.hyper import fit_profiles, label_documents
from reelspan.llm.labels import labelled_sample
from reelspan.llm.mixing import mix_sources
from reelspan.llm.packing import pack_items
from reelspan.llm.pairs import LanguageBayes, pair_defects
from reelspan.llm.structure import split_oversized
from reelspan.llm.terms import map_terms
from reelspan.llm.tokens import token_count, token_count_sql
from reelspan.runtime import cut_lineage, read

# Authors that name nobody.
NO_AUTHOR = ("", "unknown", "n/a", "-")
LIMITS = {"segment": 160, "cue": 84}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose target is no translation of their source, with the kind of defect."""
    model = LanguageBayes.fit(labelled_sample(read(spark, sf_dir, "documents", "doc_id", "lang", "text")))
    kept = read(spark, sf_dir, "glossary_terms", "canonical", "policy").where("policy = 'preserve'").select(F.col("canonical").alias("term"))
    return pair_defects(
        read(spark, sf_dir, "segments", "video_id", "id", "source_text", "target_text", "ingested_at"), model, kept,
        key=["video_id", "id"], source="source_text", target="target_text", version="ingested_at",
    )


def project_key(project: F.Column) -> F.Column:
    """Projects are the same if equal without outer blanks and letter case and with _ read as -."""
    return F.translate(F.lower(F.regexp_replace(project, rf"^{BLANK}+|{BLANK}+$", "")), "_", "-")


def project_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``project, root``: projects (as keys) tied by video or author, directly or through a chain."""
    meta = read(spark, sf_dir, "source_meta", "project_id", "video_id", "author").withColumn("p", F.concat(F.lit("p:"), project_key(F.col("project_id"))))
    author = name_key(F.col("author"))
    ties = [
        meta.where(F.trim("video_id") != "").select(F.col("p").alias("a"), F.concat(F.lit("v:"), F.col("video_id")).alias("b")),
        meta.where(~author.isin(*NO_AUTHOR)).select(F.col("p").alias("a"), F.concat(F.lit("w:"), author).alias("b")),
        read(spark, sf_dir, "span_translation_examples", "project_id").select(F.concat(F.lit("p:"), project_key(F.col("project_id"))).alias("a")).withColumn("b", F.col("a")),
    ]
    links = ties[0].unionByName(ties[1]).unionByName(ties[2])
    return connected_groups(links).where(F.col("node").startswith("p:")).select(F.col("node").alias("project"), "root")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different projects of the examples, as written, that must share a split."""
    written = read(spark, sf_dir, "span_translation_examples", "project_id").where("project_id IS NOT NULL").distinct()
    named = written.withColumn("project", F.concat(F.lit("p:"), project_key(F.col("project_id")))).join(project_groups(spark, sf_dir), "project").select("project_id", "root")
    named = cut_lineage(named)
    return named.select(F.col("project_id").alias("project_id_a"), "root").join(named.select(F.col("project_id").alias("project_id_b"), "root"), "root").where("project_id_a < project_id_b").select("project_id_a", "project_id_b")


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every example with its split; tied projects together, shares by examples."""
    examples = read(spark, sf_dir, "span_translation_examples", "example_id", "project_id", "span_id").distinct()
    grouped = examples.withColumn("project", F.concat(F.lit("p:"), project_key(F.col("project_id")))).join(project_groups(spark, sf_dir), "project", "left")
    return assign_splits(grouped, "root", read(spark, sf_dir, "split_targets")).select("example_id", "project_id", "span_id", "split_name")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized segments and cues in pieces under their limits."""
    segments = read(spark, sf_dir, "segments", "video_id", "id", "ingested_at", "source_text", "words")
    cues = read(spark, sf_dir, "display_cues", "video_id", "cue_id", "updated_at", "en_text")
    items = segments.select(F.lit("segment").alias("item_kind"), "video_id", F.col("id").alias("item_id"), F.col("ingested_at").alias("version"), F.col("source_text").alias("text"), "words")
    no_words = F.lit(None).cast(items.schema["words"].dataType)
    items = items.unionByName(cues.select(F.lit("cue").alias("item_kind"), "video_id", F.col("cue_id").alias("item_id"), F.col("updated_at").alias("version"), F.col("en_text").alias("text"), no_words.alias("words")))
    return split_oversized(items, LIMITS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that had to be cut."""
    return p4_pieces(spark, sf_dir).where("piece_no = 1 AND n_pieces > 1").select("item_kind", "video_id", "item_id")


def p5_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each typed value means, with score and edits."""
    terms = read(spark, sf_dir, "glossary_terms", "canonical", "aliases", "zh")
    rules = read(spark, sf_dir, "entity_rules", "canonical_en", "surface_forms", "canonical_native", "canonical_zh")
    glossary = terms.select(F.lit("glossary").alias("list_kind"), "canonical", F.explode(F.concat(F.array("canonical", "zh"), F.coalesce("aliases", F.array()))).alias("form"))
    entity = rules.select(F.lit("entity").alias("list_kind"), F.col("canonical_en").alias("canonical"), F.explode(F.concat(F.array("canonical_en", "canonical_native", "canonical_zh"), F.coalesce("surface_forms", F.array()))).alias("form"))
    return map_terms(read(spark, sf_dir, "term_entries", "entry_id", "list_kind", "surface_form"), glossary.unionByName(entity))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without score and edits."""
    return p5_mapped(spark, sf_dir).select("entry_id", "canonical")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and manual Chinese lines of one video that translate each other."""
    segments = read(spark, sf_dir, "segments", "video_id", "id", "start_s", "end_s", "source_text", "target_text", "words", "ingested_at")
    first, last = F.expr("array_min(transform(words, w -> w.start_s))"), F.expr("array_max(transform(words, w -> w.end_s))")
    sentences = segments.select("video_id", F.col("id").alias("key"), F.coalesce("start_s", first).alias("start"), F.coalesce("end_s", last).alias("end"), F.unix_micros("ingested_at").alias("version"), F.col("source_text").alias("text"), F.col("target_text").alias("machine"))
    dialogues = read(spark, sf_dir, "ass_dialogues", "video_id", "dialogue_id", "layer", "start_s", "end_s", "text").where("layer = 0")
    lines = dialogues.select("video_id", F.col("dialogue_id").alias("key"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.lit(0).cast("bigint").alias("version"), "text")
    return align_sentences(sentences, lines)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in containers of up to 512 tokens."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", token_count(F.col("text")).alias("size"))
    return pack_items(docs, "doc_id", "size")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that alone exceed a container, so that the packing had to cut them."""
    return p7_containers(spark, sf_dir).where("piece_no = 2").select("doc_id")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text").select("doc_id", "source", token_count(F.col("text")).alias("size"))
    return mix_sources(docs, read(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus, a row for each copy of a document."""
    return _mixed(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of each source."""
    return _mixed(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share."""
    return _mixed(spark, sf_dir)[1].where("NOT reachable").select("source")


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages, with confidence, of documents with a missing or wrong label and of the lines of mixed ones."""
    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return label_documents(docs, fit_profiles(labelled_sample(docs)))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the confidence."""
    return p9_languages(spark, sf_dir).select("doc_id", "line_no", "lang")


def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on the splits: examples, tied groups that are torn, examples without a split, and whether each split is within the largest group of its share."""
    rows = p3_splits(spark, sf_dir).withColumn("project", F.concat(F.lit("p:"), project_key(F.col("project_id")))).join(project_groups(spark, sf_dir), "project", "left")
    rows = cut_lineage(rows.select("root", "split_name"))
    groups = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split_name").alias("splits"))
    whole = groups.agg(F.sum("n").alias("n_examples"), F.count_if(F.col("splits") > 1).alias("n_torn"), F.max("n").alias("_largest"))
    lost = rows.agg(F.count_if(F.col("split_name").isNull()).alias("n_unassigned"))
    shares = read(spark, sf_dir, "split_targets").join(rows.groupBy("split_name").agg(F.count(F.lit(1)).alias("_have")), "split_name", "left").na.fill(0, ["_have"])
    near = shares.crossJoin(F.broadcast(whole)).agg(F.min(F.abs(F.col("_have") - F.col("share") * F.col("n_examples")) <= F.col("_largest")).alias("shares_met"))
    return whole.crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(near)).select("n_examples", "n_torn", "n_unassigned", "shares_met")  # one row each


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each item that was cut its characters, whether all pieces fit and share words as asked, and whether they hold the whole text."""
    pieces = p4_pieces(spark, sf_dir)
    limit = F.coalesce(*[F.when(F.col("item_kind") == k, F.lit(v)) for k, v in LIMITS.items()])
    own = F.array_join(F.slice(F.split("piece", " "), F.col("overlap_words") + 1, F.size(F.split("piece", " "))), "")
    made = pieces.groupBy("item_kind", "video_id", "item_id").agg(
        F.min(F.length("piece") <= limit).alias("fits"), F.min((F.col("overlap_words") <= 1) & ((F.col("piece_no") > 1) | (F.col("overlap_words") == 0))).alias("overlaps"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))), lambda x: x.own), "").alias("joined"),
    )
    texts = read(spark, sf_dir, "segments", "video_id", "id", "source_text", "ingested_at").where(F.length(fold(F.col("source_text"))) > LIMITS["segment"]).select(F.lit("segment").alias("item_kind"), "video_id", F.col("id").alias("item_id"), F.col("source_text").alias("text"), F.col("ingested_at").alias("at"))
    cues = read(spark, sf_dir, "display_cues", "video_id", "cue_id", "en_text", "updated_at").where(F.length(fold(F.col("en_text"))) > LIMITS["cue"]).select(F.lit("cue").alias("item_kind"), "video_id", F.col("cue_id").alias("item_id"), F.col("en_text").alias("text"), F.col("updated_at").alias("at"))
    texts = texts.unionByName(cues).groupBy("item_kind", "video_id", "item_id").agg(F.max(F.struct("at", "text"))["text"].alias("text"))
    same = F.col("joined") == F.regexp_replace("text", f"{BLANK}+", "")
    return made.join(texts, ["item_kind", "video_id", "item_id"]).select("item_kind", "video_id", "item_id", F.length(fold(F.col("text"))).alias("n_chars"), "fits", "overlaps", same.alias("whole"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on the containers: documents and tokens in them, whether any is over its capacity or counts wrong, and whether nine tenths of the room is used."""
    rows = cut_lineage(p7_containers(spark, sf_dir).where("container IS NOT NULL").select("doc_id", "container", "capacity", "container_tokens", "n_tokens"))
    boxes = rows.groupBy("container", "capacity", "container_tokens").agg(F.sum("n_tokens").alias("held")).agg(
        F.count_if((F.col("held") > F.col("capacity")) | (F.col("held") != F.col("container_tokens"))).alias("n_wrong"), (F.sum("held") >= 0.9 * F.sum("capacity")).alias("well_filled")
    )
    return rows.agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).crossJoin(F.broadcast(boxes))  # one row each


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each target source its size, whether it can reach its share, and whether the mix has of it what it should, but for the draw's chance of one in thousands."""
    docs = read(spark, sf_dir, "documents", "source", "text").select(name_key(F.col("source")).alias("source"), token_count(F.col("text")).cast("double").alias("n"))
    spread = docs.groupBy("source").agg(F.sqrt(F.sum(F.col("n") ** 2)).alias("_spread"))
    whole = docs.agg(F.sum("n").alias("_whole"))
    rows = p8_report(spark, sf_dir).join(spread, "source", "left").crossJoin(F.broadcast(whole))  # one row
    wanted = F.when(F.col("reachable"), F.col("target_share") * F.col("_whole")).otherwise(F.col("size") * F.col("max_repeats"))
    room = F.when(F.col("reachable"), 4 * F.coalesce("_spread", F.lit(0.0)) * F.sqrt(F.greatest("mean_repeats", F.lit(0.25)))).otherwise(0.0)
    return rows.select("source", "max_repeats", "size", "reachable", (F.abs(F.col("mixed_size") - wanted) <= room).alias("as_wanted"))


def p5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What typed values mean that are, case and blanks aside, a name of the list: that name."""
    typed = read(spark, sf_dir, "term_entries", "entry_id", "list_kind", "surface_form").select("entry_id", "list_kind", name_key(F.col("surface_form")).alias("key"))
    names = read(spark, sf_dir, "glossary_terms", "canonical").select(F.lit("glossary").alias("list_kind"), name_key(F.col("canonical")).alias("key")).unionByName(read(spark, sf_dir, "entity_rules", "canonical_en").select(F.lit("entity").alias("list_kind"), name_key(F.col("canonical_en")).alias("key")))
    return typed.join(names.distinct(), ["list_kind", "key"], "left_semi").select("entry_id").join(p5_found(spark, sf_dir), "entry_id")


def p1_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defect of segments whose target is null or blank."""
    blank = read(spark, sf_dir, "segments", "video_id", "id", "target_text", "ingested_at").groupBy("video_id", "id").agg(F.max_by(F.struct("target_text"), "ingested_at")["target_text"].alias("t"))
    return p1_found(spark, sf_dir).join(blank.where(F.col("t").isNull() | (F.regexp_replace("t", BLANK, "") == "")), ["video_id", "id"], "left_semi")


_KEY = "replace(lower(regexp_replace({}, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), '_', '-')"
_FOLD = "trim(regexp_replace({}, '[\\s\\pZ]+', ' ', 'g'))"

P3_SQL = f"""
WITH RECURSIVE meta AS (SELECT {_KEY.format('project_id')} AS p, video_id AS v, lower({_FOLD.format('author')}) AS w FROM source_meta),
link AS (SELECT DISTINCT 'p:' || p AS a, 'v:' || v AS b FROM meta WHERE trim(v) <> ''
  UNION SELECT DISTINCT 'p:' || p, 'w:' || w FROM meta WHERE w NOT IN ('', 'unknown', 'n/a', '-')),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
named AS (SELECT DISTINCT project_id, 'p:' || {_KEY.format('project_id')} AS p FROM span_translation_examples WHERE project_id IS NOT NULL),
reach AS (SELECT DISTINCT p AS origin, p AS node FROM named UNION SELECT reach.origin, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.node)
SELECT x.project_id AS project_id_a, y.project_id AS project_id_b
FROM named x JOIN reach ON reach.origin = x.p JOIN named y ON y.p = reach.node WHERE x.project_id < y.project_id
"""
P4_SQL = f"""
SELECT DISTINCT 'segment' AS item_kind, video_id, id AS item_id FROM segments WHERE length({_FOLD.format('source_text')}) > 160
UNION ALL SELECT DISTINCT 'cue', video_id, cue_id FROM display_cues WHERE length({_FOLD.format('en_text')}) > 84
"""
P7_SQL = f"SELECT doc_id FROM documents WHERE {token_count_sql('text')} > 512"
P8_SQL = f"""
WITH d AS (SELECT lower({_FOLD.format('source')}) AS source, {token_count_sql('text')} AS size FROM documents),
s AS (SELECT source, sum(size) AS size FROM d GROUP BY 1)
SELECT lower({_FOLD.format('t.source')}) AS source FROM mix_targets t LEFT JOIN s ON s.source = lower({_FOLD.format('t.source')})
WHERE t.max_repeats * coalesce(s.size, 0) < t.target_share * (SELECT sum(size) FROM d)
"""

P3_KEPT_SQL = "SELECT count(*) AS n_examples, CAST(0 AS BIGINT) AS n_torn, CAST(0 AS BIGINT) AS n_unassigned, true AS shares_met FROM (SELECT DISTINCT example_id, project_id, span_id FROM span_translation_examples)"
P4_KEPT_SQL = f"""
SELECT 'segment' AS item_kind, video_id, id AS item_id, length({_FOLD.format('arg_max(source_text, (ingested_at, source_text))')}) AS n_chars, true AS fits, true AS overlaps, true AS whole FROM segments WHERE length({_FOLD.format('source_text')}) > 160 GROUP BY video_id, id
UNION ALL SELECT 'cue', video_id, cue_id, length({_FOLD.format('arg_max(en_text, (updated_at, en_text))')}), true, true, true FROM display_cues WHERE length({_FOLD.format('en_text')}) > 84 GROUP BY video_id, cue_id
"""
P7_FILL_SQL = f"SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_wrong, true AS well_filled FROM (SELECT doc_id, {token_count_sql('text')} AS n FROM documents) WHERE n > 0"
P8_SHARES_SQL = f"""
WITH d AS (SELECT lower({_FOLD.format('source')}) AS source, {token_count_sql('text')} AS size FROM documents), s AS (SELECT source, sum(size) AS size FROM d GROUP BY 1)
SELECT lower({_FOLD.format('t.source')}) AS source, t.max_repeats, CAST(coalesce(s.size, 0) AS BIGINT) AS size, t.max_repeats * coalesce(s.size, 0) >= t.target_share * (SELECT sum(size) FROM d) AS reachable, true AS as_wanted
FROM mix_targets t LEFT JOIN s ON s.source = lower({_FOLD.format('t.source')})
"""
P5_EXACT_SQL = f"""
WITH n AS (SELECT DISTINCT 'glossary' AS list_kind, canonical FROM glossary_terms UNION SELECT DISTINCT 'entity', canonical_en FROM entity_rules)
SELECT entry_id, canonical FROM term_entries e JOIN n ON n.list_kind = e.list_kind AND lower({_FOLD.format('surface_form')}) = lower({_FOLD.format('canonical')})
"""
P1_BLANK_SQL = "SELECT video_id, id, 'empty' AS defect FROM (SELECT video_id, id, arg_max(coalesce(target_text, ''), ingested_at) AS t FROM segments GROUP BY 1, 2) WHERE regexp_replace(t, '[\\s\\pZ]', '', 'g') = ''"

QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_splits": p3_splits, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_mapped": p5_mapped, "p6_found": p6_found, "p7_found": p7_found, "p7_containers": p7_containers, "p8_found": p8_found, "p8_mix": p8_mix, "p8_report": p8_report, "p9_found": p9_found, "p9_languages": p9_languages, "p1_blank": p1_blank, "p3_kept": p3_kept, "p4_kept": p4_kept, "p5_exact": p5_exact, "p7_fill": p7_fill, "p8_shares": p8_shares}
SQL = {"p3_found": P3_SQL, "p4_found": P4_SQL, "p7_found": P7_SQL, "p8_found": P8_SQL, "p1_blank": P1_BLANK_SQL, "p3_kept": P3_KEPT_SQL, "p4_kept": P4_KEPT_SQL, "p5_exact": P5_EXACT_SQL, "p7_fill": P7_FILL_SQL, "p8_shares": P8_SHARES_SQL}
