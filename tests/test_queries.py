import duckdb
import pytest

import __spark_entry__ as entry
from reelspan import plans

SF = "/root/testdata/sf0.001"


def shown(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return repr(value)


@pytest.fixture(scope="module")
def tables():
    from pathlib import Path

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.all_sql()))
def test_query_equals_sql(spark, tables, name):
    df = plans.all_queries()[name](spark, SF)
    rel = tables.execute(plans.all_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    place = [df.columns.index(c) for c in columns]
    got = sorted(tuple(shown(r[i]) for i in place) for r in df.collect())
    assert got == sorted(tuple(map(shown, r)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.all_queries()) - set(plans.all_sql())))
def test_query_without_sql_runs(spark, name):
    """Their results are held to SQL by queries on their totals (refined_words, reading_group_sizes, merged_cue_sizes, difficult_span_bounds)."""
    rows = plans.all_queries()[name](spark, SF).collect()
    assert rows and all(r.video_id is not None for r in rows)
    if "start_ms" in rows[0].asDict():
        assert all(r.start_ms < r.end_ms for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
