from pathlib import Path

import duckdb
import pytest

from reelspan.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = Q.QUERIES[name](spark, SF)
    rel = con.execute(Q.SQL[name])
    columns = [c[0] for c in rel.description]
    assert columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


KEYS = {
    "p1_found": ["video_id", "id"], "p3_splits": ["example_id", "project_id", "span_id"], "p4_pieces": ["item_kind", "video_id", "item_id", "piece_no"], "p5_found": ["entry_id"], "p5_mapped": ["entry_id"],
    "p6_found": ["video_id", "segment_id", "dialogue_id"], "p7_containers": ["doc_id", "piece_no"], "p8_mix": ["doc_id", "copy"], "p8_report": ["source"], "p9_found": ["doc_id", "line_no"], "p9_languages": ["doc_id", "line_no"],
}


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_has_each_key_once(spark, name):
    """What SQL can't recompute is held to SQL by p1_blank, p3_kept, p4_kept, p5_exact, p7_fill and p8_shares; here, that no key is null or repeated."""
    rows = [tuple(r) for r in Q.QUERIES[name](spark, SF).select(*KEYS[name]).collect()]
    assert rows and len(rows) == len(set(rows)) and all(x is not None for r in rows for x in r)
