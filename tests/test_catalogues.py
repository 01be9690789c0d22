import json

from reelspan.sources import catalogues as C


def docs(spark, *values):
    return spark.createDataFrame([(k, v if isinstance(v, str) or v is None else json.dumps(v)) for k, v in enumerate(values)], "n int, value string")


def test_glossaries_and_registries(spark):
    terms = {"version": 1, "terms": [{"canonical": " Node.js ", "aliases": ["node", " ", None]}, {"canonical": ""}, {"canonical": "Metro", "zh": "地铁", "policy": "Translate"}]}
    got = sorted((r.canonical, r.zh, r.policy, r.aliases) for r in C.glossary_terms(docs(spark, terms, "no json", None, {"other": 1})).collect())
    assert got == [("Metro", "地铁", "translate", []), ("Node.js", "Node.js", "preserve", ["node"])]
    entities = {"entities": [{"key": "k", "canonical_en": "A", "confidence": 0.2}, {"key": "k", "canonical_en": "B", "confidence": 0.9}, {"canonical_en": "Lone  One"}]}
    assert sorted((r.key, r.canonical_en) for r in C.entity_rules(docs(spark, entities)).collect()) == [("k", "B"), ("lone one", "Lone  One")]


def test_evidence(spark):
    good = {"source": "s", "title": "The Tape", "url": "https://x.example/a", "summary": "about a tape and a city", "confidence": "unknown", "project_id": "p", "evidence_level": "advisory", "schema_version": 1}
    rows = C.evidence(docs(spark, good, good | {"url": "ftp:x"}, good | {"confidence": "1.5"}, good | {"confidence": "0.5", "project_id": "q"}, good | {"schema_version": 9}, good | {"title": "", "url": "", "summary": " "}, good | {"evidence_level": "rumour"}, "{", None))
    assert sorted((r.project_id, r.confidence) for r in rows.collect()) == [("p", None), ("q", 0.5)]
    assert C.search_evidence(rows, ["TAPE", "city"], "p").count() == 1
    assert C.search_evidence(rows, [], "p").count() == C.search_evidence(rows, ["tape", "absent"], "p").count() == 0


def test_candidates(spark):
    answer = {"data": {"result": [{"title": "<em>寂静</em>花园", "bvid": "BV1ab", "author": " a ", "duration": "1:05", "pubdate": 0, "description": "x &amp; y"}, {"title": "t", "bvid": "av1"}]}}
    got = C.api_candidates(docs(spark, answer, {"code": -1}, None)).collect()
    assert [(r.bvid, r.title, r.author, r.duration_s, r.description) for r in got] == [("BV1ab", "寂静 花园", "a", 65.0, "x & y")]
    page = '<a href="/video/BV1ab?x" title="寂静花园"><b>…</b></a><a href="//h/video/BV1ab">again</a><a href="/video/BV2cd"><i>母带</i></a><a href="/video/BV3">  </a>'
    assert sorted((r.bvid, r.title) for r in C.page_candidates(docs(spark, page, "", None)).collect()) == [("BV1ab", "寂静花园"), ("BV2cd", "母带")]
