import random

from pyspark.sql import functions as F

from reelspan.operators.overlap import best_overlap, chunk_plan, overlap_join
from reelspan.operators.sequences import first_mentions, islands, neighbours, renumber, running_last, running_sum


def rows(spark, n=300):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), k, rng.randrange(0, 50_000), rng.choice([None, "x", "y", "z"])) for k in range(n)]
    return data, spark.createDataFrame([(v, k, s, s + 5, t) for v, k, s, t in data], "video_id string, id long, start_ms long, end_ms long, text string")


def test_neighbours_sums_and_lasts_across_shards(spark):
    data, df = rows(spark)
    kw = {"shard_ms": 1000}
    near = {(r.video_id, r.id): (r.prev.id if r.prev else None, r.next.id if r.next else None) for r in neighbours(df, ["video_id"], ["id"], **kw).collect()}
    sums = {r.id: r.s for r in running_sum(df, ["video_id"], F.col("id"), "s", **kw).collect()}
    lasts = {r.id: r.t for r in running_last(df, ["video_id"], F.col("text"), "t", **kw).collect()}
    for video in ("a", "b", None):
        own = sorted((r for r in data if r[0] == video), key=lambda r: (r[2], r[1]))
        total, last = 0, None
        for k, r in enumerate(own):
            assert near[(video, r[1])] == (own[k - 1][1] if k else None, own[k + 1][1] if k + 1 < len(own) else None)
            total += r[1]
            assert sums[r[1]] == total
            assert lasts[r[1]] == last
            last = r[3] if r[3] is not None else last


def test_numbers_and_islands(spark):
    _, df = rows(spark, 50)
    seq = renumber(df, ["video_id"]).groupBy("video_id").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.countDistinct("seq").alias("n"), F.count("*").alias("m")).collect()
    assert all(r.a == 1 and r.b == r.n == r.m for r in seq)
    assert islands(df, ["video_id"], F.lit(False), "i").select("i").distinct().collect()[0].i == 0
    assert first_mentions(df, ["video_id"]).count() == df.select("video_id").distinct().count()


def test_overlap_join_equals_product(spark):
    rng = random.Random(3)
    make = lambda n, at: [(rng.choice(["a", "b"]), at + k, s := rng.randrange(0, 3_000_000), s + rng.choice([0, 5, 4000, 30_000, 700_000, 90_000_000])) for k in range(n)]
    left, right = make(120, 0), make(120, 1000)
    a = spark.createDataFrame(left, "k string, id long, start_ms long, end_ms long")
    b = spark.createDataFrame(right, "k string, rid long, start_ms long, end_ms long")
    want = sorted((x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in left for y in right if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2]))
    pairs = overlap_join(a, b, "k")
    assert sorted((r[0], r[1], r[2]) for r in pairs.select("l.id", "r.rid", "overlap_ms").collect()) == want
    best = best_overlap(a, b, "k", ["id"], "rid", min_ratio=0.5)
    lengths = {x[1]: x[3] - x[2] for x in left}
    top = {}
    for i, j, o in want:
        top[i] = max(top.get(i, 0), o)
    assert {r[0]: r[1] for r in best.select("l.id", "overlap_ms").collect()} == {i: o for i, o in top.items() if o >= 0.5 * lengths[i]}


def test_overlap_join_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, id long, start_ms long, end_ms long")
    assert overlap_join(empty, empty, "k").count() == 0


def test_chunk_plan(spark):
    df = spark.createDataFrame([("v", 1_000_000), ("w", 480_000), ("x", 0)], "v string, total long")
    got = [(r.v, r.chunk, r.core_start_ms, r.core_end_ms, r.start_ms, r.end_ms, r.is_last) for r in chunk_plan(df, "total").orderBy("v", "chunk").collect()]
    assert got == [("v", 0, 0, 480_000, 0, 481_000, False), ("v", 1, 480_000, 960_000, 479_000, 961_000, False), ("v", 2, 960_000, 1_000_000, 959_000, 1_000_000, True), ("w", 0, 0, 480_000, 0, 480_000, True)]
