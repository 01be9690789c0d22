import random
from collections import defaultdict

from reelspan.llm.groups import allot, assign_splits, connected_groups, forest


def groups(spark, links, **kw):
    got = connected_groups(spark.createDataFrame(links, "a string, b string"), **kw).collect()
    by = defaultdict(set)
    for r in got:
        by[r.root].add(r.node)
    assert len({r.node for r in got}) == len(got)
    return sorted(map(sorted, by.values()))


def brute(links):
    by = defaultdict(set)
    for node, root in forest((a, b) for a, b in links if a is not None and b is not None).items():
        by[root].add(node)
    return sorted(map(sorted, by.values()))


def test_levels_give_what_one_forest_gives(spark):
    rng = random.Random(4)
    chain = [(f"c{k}", f"c{k + 1}") for k in range(200)]
    hub = [("hub", f"h{k}") for k in range(150)]
    loose = [(f"x{rng.randrange(80)}", f"y{rng.randrange(80)}") for _ in range(60)]
    links = chain + hub + loose + [("self", "self"), (None, "x"), ("x", None), ("c3", "c4")]
    rng.shuffle(links)
    want = brute(links)
    assert groups(spark, links) == want
    assert groups(spark, links, finish_links=40, local_links=60) == want


def test_no_links(spark):
    assert groups(spark, []) == []


def test_allotment_is_greedy():
    rng = random.Random(5)
    sizes = [(s, rng.randrange(1, 40)) for s in (50, 20, 7, 3, 1)]
    shares = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]
    left = {k: v * sum(s * c for s, c in sizes) for k, v in shares}
    want = {}
    for size, count in sorted(sizes, reverse=True):
        for _ in range(count):
            name = max(left, key=left.__getitem__)
            want[(size, name)] = want.get((size, name), 0) + 1
            left[name] -= size
    got = {(s, k): n for s, parts in allot(sizes, shares).items() for k, n in parts}
    assert got == want
    many = dict(allot([(1, 1_000_000)], shares)[1])
    assert sum(many.values()) == 1_000_000 and abs(many["train"] - 800_000) <= 1


def test_groups_stay_whole(spark):
    rows = [(k, None if k % 50 == 0 else f"g{min(k % 97, 30)}", "clash", "old") for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, grp string, _g string, split_name string")
    shares = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), (None, 0.5), ("none", 0.0)], "split_name string, share double")
    out = assign_splits(df, "grp", shares).collect()
    assert len(out) == 2000 and all(r._g == "clash" for r in out)
    by = defaultdict(set)
    for r in out:
        by[r.grp].add(r.split_name)
    assert all(len(x) == 1 for x in by.values())
    assert {r.split_name for r in out} <= {"train", "validation", "test"}
    small = spark.createDataFrame([(k, f"g{k}") for k in range(1000)], "id long, grp string")
    n = {r.split_name: r["count"] for r in assign_splits(small, "grp", shares).groupBy("split_name").count().collect()}
    assert n == {"train": 800, "validation": 100, "test": 100}


def test_hot_groups_go_with_their_rows(spark):
    rows = [(k, "hot" if k % 3 == 0 else None if k % 3 == 1 else f"g{k}") for k in range(3000)]
    shares = spark.createDataFrame([("train", 0.6), ("test", 0.4)], "split_name string, share double")
    out = assign_splits(spark.createDataFrame(rows, "id long, grp string"), "grp", shares).collect()
    assert sorted(r.id for r in out) == list(range(3000))
    by = defaultdict(set)
    for r in out:
        by[r.grp].add(r.split_name)
    assert all(len(x) == 1 and None not in x for x in by.values())
    n = sum(r.split_name == "train" for r in out)
    assert 1700 <= n <= 2100


def test_no_rows_and_no_shares(spark):
    df = spark.createDataFrame([], "id long, grp string")
    shares = spark.createDataFrame([("train", 1.0)], "split_name string, share double")
    assert assign_splits(df, "grp", shares).count() == 0
    one = spark.createDataFrame([(1, "a")], "id long, grp string")
    assert assign_splits(one, "grp", shares.limit(0)).first().split_name is None
