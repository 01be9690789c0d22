"""Connected groups of records by distributed union-find, and splits that keep groups whole."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.runtime import cut_lineage, width

#: Links up to which the last forest is merged in one task; more go through another level.
FINISH_LINKS = 10_000
#: Links of one local forest at most.
LOCAL_LINKS = 500_000
#: Groups of one size that are ranked in one task, about.
_BUCKET_GROUPS = 100_000


def forest(links: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Union-find with path halving: each node with the least node of its tree."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tree = forest((a, b) for pdf in batches for a, b in zip(pdf["a"], pdf["b"], strict=True))
    if tree:
        yield pd.DataFrame({"node": list(tree), "root": list(tree.values())})


def connected_groups(links: DataFrame, *, finish_links: int = FINISH_LINKS, local_links: int = LOCAL_LINKS) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b``); nodes share a root exactly if a chain joins them.

    Level by level: each task builds the forest of its own links, which leaves at most one link a
    node; over these forests every node takes the representative that is least by a hash seeded
    with the level among itself and its neighbours, and the links between representatives are the
    next, smaller level (a constant fraction of the nodes goes, in expectation, whatever the shape, long
    chains included). A level of at most ``finish_links`` links is merged by one last forest. Roots
    then pass down the levels by joins on the representative. A hot node costs one link a task after its local
    forest, and the choice of representatives is an aggregation with partial sums, so it isn't gathered anywhere.

    Cases: links with a null end are left out; self-links make a group of one; repeated and reversed
    links change nothing; no links give no rows.
    """
    spark = links.sparkSession
    edges = links.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n, level, steps = edges.count(), 0, []
    while True:
        local = edges.repartition(max(1, -(-n // local_links), min(width(spark), -(-n // 1000)))).mapInPandas(_forests, "node string, root string")
        if n <= finish_links:  # the forests go through a shuffle, so each is built by a task of its own
            tree = local.select(F.col("node").alias("a"), F.col("root").alias("b")).repartition(1).mapInPandas(_forests, "node string, root string")
            break
        local = cut_lineage(local)
        rank = lambda c: F.xxhash64(F.col(c), F.lit(level))  # noqa: B023, E731
        near = local.select("node", F.col("root").alias("other")).unionByName(local.select(F.col("root").alias("node"), F.col("node").alias("other")))
        rep = cut_lineage(near.groupBy("node").agg(F.min(F.struct(rank("other").alias("h"), F.col("other").alias("x"))).alias("m")).select("node", F.when(rank("node") <= F.col("m.h"), F.col("node")).otherwise(F.col("m.x")).alias("rep")))
        steps.append(rep)
        ends = local.where("node <> root").join(rep, "node").select(F.col("rep").alias("x"), F.col("root").alias("node")).join(rep, "node").select(F.col("x"), F.col("rep").alias("y"))
        edges = cut_lineage(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        n, level = edges.count(), level + 1
    for rep in reversed(steps):
        up = tree.withColumnRenamed("node", "rep").withColumnRenamed("root", "top")
        tree = rep.join(up, "rep", "left").select("node", F.coalesce("top", "rep").alias("root"))
    return tree


def allot(sizes: list[tuple[int, int]], shares: list[tuple[str, float]]) -> dict[int, list[tuple[str, int]]]:
    """Greedy, largest first: of each size, how many groups go to which split, each to the split furthest below its target.

    ``sizes``: (size, number of groups). Runs of groups of one size are placed in blocks: while every
    split stays within the block's size of the greedy order the result is the same as one by one.
    Ties go to the split named first.
    """
    total = sum(s * c for s, c in sizes)
    whole = sum(w for _, w in shares)
    left = {name: total * w / whole for name, w in shares}
    out: dict[int, list[tuple[str, int]]] = {}
    for size, count in sorted(sizes, reverse=True):
        given = dict.fromkeys(left, 0)
        block = count - 1000 * len(left)
        if block > 0 and size:  # far from the end, greedy lowers the highest remainders evenly
            order = sorted(left, key=lambda k: -left[k])
            need, level = block * size, 0.0
            for i, name in enumerate(order):
                below = left[order[i + 1]] if i + 1 < len(order) else float("-inf")
                level = (sum(left[k] for k in order[: i + 1]) - need) / (i + 1)
                if level >= below:
                    break
            for name in order:
                k = max(0, min(block - sum(given.values()), int((left[name] - level) // size)))
                given[name] += k
                left[name] -= k * size
        for _ in range(count - sum(given.values())):
            name = max(left, key=left.__getitem__)
            given[name] += 1
            left[name] -= size
        out[size] = [(k, v) for k, v in given.items() if v]
    return out


def assign_splits(records: DataFrame, group: str, shares: DataFrame) -> DataFrame:
    """``records`` with ``split_name``; all rows of one ``group`` land in one split, shares (``split_name, share``) are met by rows.

    Only the histogram of group sizes comes to the driver: groups of N rows have fewer than
    sqrt(2N) distinct sizes. Groups of one size are ranked by hash in buckets, as many as there are groups for, whose offsets come
    from their counts, so that no size is ordered in one task. Groups with more rows than a task should get are few (at most a task's
    share of them fits into all rows), so they are sent to the rows; only the others' rows are shuffled to their group.

    Cases: rows with a null group form one group.
    No shares: ``split_name`` is null. Shares that are null or not positive get nothing. Fewer groups
    than splits leave splits empty. A column ``split_name`` of ``records`` is replaced.
    """
    records = records.drop("split_name")
    want = [(r[0], float(r[1])) for r in shares.select("split_name", "share").collect() if r[0] is not None and r[1] and r[1] > 0]
    if not want:
        return records.withColumn("split_name", F.lit(None).cast("string"))
    spark = records.sparkSession
    sizes = cut_lineage(records.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_size")))
    n_groups, n_rows = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    sizes = sizes.withColumn("_b", F.pmod(F.xxhash64("_g"), F.lit(max(1, -(-n_groups // _BUCKET_GROUPS)))))
    counts = sizes.groupBy("_size").count().collect()
    ends = []
    for size, parts in allot([(r[0], r[1]) for r in counts], want).items():
        at = 0
        for name, k in parts:
            ends.append((size, at, at + k, name))
            at += k
    table = spark.createDataFrame(ends or [(0, 0, 0, "")], "_size long, _from long, _to long, split_name string")
    before = Window.partitionBy("_size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.groupBy("_size", "_b").count().select("_size", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    ranked = (
        sizes.withColumn("_k", F.row_number().over(Window.partitionBy("_size", "_b").orderBy(F.xxhash64("_g"), "_g")))
        .join(offsets, ["_size", "_b"]).withColumn("_k", F.col("_k") + F.col("_off") - 1)
    )
    inside = (F.col("r._size") == F.col("t._size")) & (F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_to"))
    placed = cut_lineage(ranked.alias("r").join(table.alias("t"), inside).select(F.col("_g").alias("_group"), F.col("r._size").alias("_size"), "split_name"))
    hot_rows = max(1, -(-n_rows // (4 * width(spark))))  # so no more than 4 x width groups are hot
    hot = F.broadcast(placed.where(F.col("_size") >= hot_rows).select("_group", "split_name").alias("h"))
    cold = placed.where(F.col("_size") < hot_rows).select("_group", "split_name")
    mine = records.withColumn("_row", F.struct(*records.columns)).select("_row", F.col(group).alias("_mine"))
    sent = mine.join(hot, F.col("_mine").eqNullSafe(F.col("h._group")), "left").select("_row", "_mine", F.col("h.split_name").alias("_hot"))
    # rows that have their split spread by hash and meet no group
    spread = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(F.to_json("_row")), F.lit(1 << 31)) + 1).otherwise(F.lit(0))
    sent = sent.select("_row", "_hot", F.when(F.col("_hot").isNull(), F.col("_mine")).alias("_mine"), spread.alias("_apart"))
    met = sent.join(cold.withColumn("_apart", F.lit(0).cast("bigint")).alias("c"), F.col("_mine").eqNullSafe(F.col("c._group")) & (sent["_apart"] == F.col("c._apart")), "left")
    return met.select("_row.*", F.coalesce("_hot", F.col("c.split_name")).alias("split_name"))
