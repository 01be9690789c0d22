import random

from reelspan.operators.intervals import merge_intervals, periods_and_gaps

SCHEMA = "video_id string, row_id long, start_ms long, end_ms long, version long, _s string, n_rows string"


def brute(rows):
    """Stretches of each entity: start, end, rows, end of the stretch before."""
    out = []
    for video in {r[0] for r in rows}:
        newest = {}
        for r in rows:
            if r[0] == video and (r[1] not in newest or tuple(-1 if x is None else x for x in (r[4], r[2], r[3])) > tuple(-1 if x is None else x for x in newest[r[1]])):
                newest[r[1]] = (r[4], r[2], r[3])
        spans = sorted((s, e) for _, s, e in newest.values() if s is not None and e is not None and e > s)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1] = [merged[-1][0], max(merged[-1][1], e), merged[-1][2] + 1]
            else:
                merged.append([s, e, 1])
        out += [(video, s, e, n, merged[k - 1][1] if k else None) for k, (s, e, n) in enumerate(merged)]
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return sorted(map(tuple, merge_intervals(df, ["video_id"], "row_id", version="version", **kw).collect()), key=str)


def test_equals_brute_force_over_many_shards(spark):
    rng = random.Random(1)
    rows = []
    for k in range(600):
        start = rng.randrange(0, 200_000)
        rows.append((rng.choice(["a", "a", "a", "b", None]), k % 450, start, start + rng.choice([0, -5, 10, 900, 4_000, 60_000]), rng.randrange(3)))
    rows += [("a", 9001, None, 5, 0), ("a", 9002, 5, None, 0), ("b", 9003, 0, 10**12, 0)]
    assert run(spark, rows, shard_ms=1000) == brute(rows)


def test_touching_nested_and_repeated(spark):
    rows = [("v", 1, 0, 10, 1), ("v", 1, 0, 10, 2), ("v", 2, 10, 20, 1), ("v", 3, 12, 15, 1), ("v", 4, 30, 40, 1), ("v", 5, 40, 41, 1)]
    assert run(spark, rows, shard_ms=7) == [("v", 0, 20, 3, None), ("v", 30, 41, 2, 20)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_periods_and_gaps(spark):
    df = spark.createDataFrame([("v", 0, 20, 2, None), ("v", 1600, 1700, 1, 20), ("v", 3200, 3300, 1, 1700)], "video_id string, start_ms long, end_ms long, n_rows long, prev_end_ms long")
    got = {tuple(r) for r in periods_and_gaps(df, ["video_id"]).collect()}
    assert got == {("v", "period", 0, 20), ("v", "gap", 20, 1600), ("v", "gap", 1700, 3200)}
