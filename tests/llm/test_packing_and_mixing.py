import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelspan.llm.mixing import mix_sources, poisson_steps
from reelspan.llm.packing import best_fit, pack_items
from reelspan.llm.tokens import token_count


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 512), max_size=200))
def test_containers_hold_their_items(sizes):
    where, capacity, held = best_fit(sizes, (128, 256, 384, 512))
    sums = defaultdict(int)
    for size, k in zip(sizes, where, strict=True):
        sums[k] += size
    assert [sums[k] for k in range(len(held))] == held
    assert all(h <= c and not any(h <= x < c for x in (128, 256, 384, 512)) for h, c in zip(held, capacity, strict=True))


def test_little_room_is_left():
    rng = random.Random(6)
    sizes = [min(512, int(rng.lognormvariate(4, 1)) + 1) for _ in range(5000)]
    where, capacity, _ = best_fit(sizes, (128, 256, 384, 512))
    assert sum(sizes) / sum(capacity) > 0.99
    assert len(set(where)) == len(capacity)


def test_items_are_whole(spark):
    rows = [(1, 513), (2, 1024), (3, 0), (4, None), (5, -3), (6, 100), (6, 100), (7, 512), (None, 30)]
    out = pack_items(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, size long, container long"), "doc_id", "size", shard_items=3).collect()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append((r.piece_no, r.start_token, r.n_tokens))
    assert sorted(by[1]) == [(1, 0, 512), (2, 512, 1)] and sorted(by[2]) == [(1, 0, 512), (2, 512, 512)]
    assert len(by[6]) == 2 and [len(by[k]) for k in (3, 4, 5, 7, None)] == [1] * 5
    filled = defaultdict(int)
    for r in out:
        if r.container is not None:
            filled[(r.container, r.capacity, r.container_tokens)] += r.n_tokens
    assert all(n == key[2] <= key[1] for key, n in filled.items()) and len({k[0] for k in filled}) == len(filled)
    assert pack_items(spark.createDataFrame([], "doc_id long, size long"), "doc_id", "size").count() == 0


def test_packing_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.randrange(150), rng.choice([7, 30, 90, 400, 700])) for _ in range(400)], "doc_id long, size long")
    rows = lambda d: sorted((tuple(r) for r in pack_items(d, "doc_id", "size", shard_items=50).collect()), key=repr)
    assert rows(df.repartition(1)) == rows(df.repartition(7, "size"))


def test_tokens(spark):
    texts = ["中文 ab12,x", "ツアー。", None, "", "a\u3000b\u00a0c", "😀é e\u0301", "naïve-test"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t")).alias("n")).collect()]
    assert got == [5, 4, 0, 0, 3, 4, 3]


@pytest.mark.parametrize(("mean", "most"), [(0.3, 1), (0.99, 1), (1.7, 3), (2.9, 3), (5, 3), (0, 4), (2, 0)])
def test_capped_poisson_has_its_mean(mean, most):
    steps = poisson_steps(mean, most)
    assert len(steps) == most and steps == sorted(steps)
    assert most - sum(steps) == pytest.approx(min(mean, most), abs=1e-6)


def test_mix(spark):
    rng = random.Random(7)
    docs = [(k, rng.choice([" A ", "a", "B"]) if k % 10 else rng.choice(["c", None, "tiny"]), rng.randrange(1, 50)) for k in range(20_000)] + [(90_000, "a", None), (90_001, "b", -4)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, size long, copy string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 3), ("tiny", 0.15, 2), ("absent", 0.05, 5), ("void", None, None), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mix_sources(df, targets)
    rep = {r.source: r for r in report.collect()}
    whole = sum(max(0, d[2] or 0) for d in docs)
    assert {k: r.reachable for k, r in rep.items()} == {"a": True, "b": True, "tiny": False, "absent": False, "void": True}
    for k in ("a", "b"):
        assert rep[k].mixed_size == pytest.approx(rep[k].target_share * whole, rel=0.05)
    assert rep["tiny"].mixed_size == 2 * rep["tiny"].size and rep["absent"].mixed_size == 0
    rows = mixed.collect()
    times = defaultdict(int)
    for r in rows:
        times[(r.source, r.doc_id)] = max(times[(r.source, r.doc_id)], r.copy)
    assert all(n <= {"a": 1, "b": 3, "tiny": 2}[s] for (s, _), n in times.items())
    assert sum(r.size for r in rows) == sum(r.mixed_size for r in rep.values())
    assert [r.doc_id for r in rows[:50]] != sorted(r.doc_id for r in rows[:50])
    again = mix_sources(df.repartition(7), targets)[0].collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in rows]


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, size long")
    mixed, report = mix_sources(df, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"))
    assert mixed.count() == 0 and report.first().actual_share is None
