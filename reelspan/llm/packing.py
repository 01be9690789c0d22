"""Filling containers of fixed capacity with little unused space."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.runtime import cut_lineage

#: Items that one task packs; each such shard leaves a few containers less than full.
SHARD_ITEMS = 50_000
#: Tokens that a container costs besides its capacity, when sizes to open are compared.
OPENING_COST = 8


def best_fit(sizes: Sequence[int], capacities: Sequence[int], opening_cost: float = OPENING_COST) -> tuple[list[int], list[int], list[int]]:
    """Best fit in falling order of size: container of each item, then capacity and contents of each container.

    An item goes where it leaves least room. If it fits nowhere, a container is opened of the permitted
    capacity that costs least for what it can still take: (capacity + opening cost) by the tokens that it will hold,
    its item and as much of the smaller items still to come as fits. In the end each container shrinks to
    the least permitted capacity that holds its contents. Open containers are found by their
    room in one bit set, so a shard takes time in proportion to its items.
    """
    permitted = sorted({int(c) for c in capacities})
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    still = sum(sizes)
    room: list[int] = []
    held: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(permitted[-1] + 1)]
    open_rooms = 0
    where = [0] * len(sizes)
    for i in order:
        size = sizes[i]
        if size > permitted[-1]:
            raise ValueError("an item is larger than every permitted capacity")
        still -= size
        fitting = open_rooms >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            k = by_room[free].pop()
            if not by_room[free]:
                open_rooms &= ~(1 << free)
        else:
            free = min((c for c in permitted if c >= size), key=lambda c: ((c + opening_cost) / max(1, size + min(c - size, still)), c))
            k = len(room)
            room.append(free)
            held.append(0)
        free -= size
        room[k] = free
        held[k] += size
        by_room[free].append(k)
        open_rooms |= 1 << free
        where[i] = k
    return where, [next(c for c in permitted if c >= h) for h in held], held


def _packer(capacities: Sequence[int], opening_cost: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", "_whole", "_nth", "piece_no"], kind="stable").reset_index(drop=True)
        where, capacity, held = best_fit(pdf["n_tokens"].tolist(), capacities, opening_cost)
        shard = pdf["_shard"].iloc[0] if len(pdf) else 0
        return pd.DataFrame({
            "_id": pdf["_id"], "piece_no": pdf["piece_no"], "n_pieces": pdf["n_pieces"], "start_token": pdf["start_token"], "n_tokens": pdf["n_tokens"],
            "container": [f"s{shard}-{k}" for k in where], "capacity": [capacity[k] for k in where], "container_tokens": [held[k] for k in where],
        })

    return pack


def pack_items(items: DataFrame, item_id: str, size: str, *, capacities: Sequence[int] = (128, 256, 384, 512), shard_items: int = SHARD_ITEMS, opening_cost: float = OPENING_COST) -> DataFrame:
    """Which part of which item lies in which container.

    Columns: ``item_id, piece_no, n_pieces, start_token, n_tokens, container, capacity, container_tokens``. Only items over
    the largest capacity are cut: full pieces are containers of their own and are never gathered, the
    rest of such an item is packed like any item. Items are spread by hash over shards of a bounded number of
    items, each packed by itself; more items mean more shards. The result is the same on every run and for any partitioning.

    Cases: items of null, zero or negative size come out once with ``n_tokens`` 0 and no container; repeated
    rows are items each; a null id is a value; no items, no rows; further columns are ignored.
    """
    largest = max(capacities)
    rows = items.select(F.col(item_id).alias("_id"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("_n"))
    # rows that repeat an id are told apart by their size and a number, so that the result doesn't depend on partitions
    rows = cut_lineage(rows.groupBy("_id", "_n").count()).select("_id", "_n", "count")
    shards = max(1, -(-(rows.agg(F.sum("count")).first()[0] or 0) // shard_items))
    rows = rows.select("_id", "_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("count"))).alias("_nth"))
    pieces = (
        rows.withColumn("n_pieces", F.greatest(F.ceil(F.col("_n") / largest), F.lit(1)).cast("int"))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))))
        .withColumn("start_token", ((F.col("piece_no") - 1) * largest).cast("bigint"))
        .withColumn("n_tokens", F.least(F.col("_n") - F.col("start_token"), F.lit(largest)).cast("bigint"))
    )
    columns = ["_id", "piece_no", "n_pieces", "start_token", "n_tokens"]
    alone = pieces.where((F.col("n_tokens") == largest) | (F.col("n_tokens") == 0)).select(
        *columns,
        F.when(F.col("n_tokens") > 0, F.concat_ws("-", F.lit("f"), F.col("_id").cast("string"), F.col("_n").cast("string"), F.col("_nth").cast("string"), F.col("piece_no").cast("string"))).alias("container"),
        F.when(F.col("n_tokens") > 0, F.lit(largest)).cast("bigint").alias("capacity"),
        F.when(F.col("n_tokens") > 0, F.col("n_tokens")).cast("bigint").alias("container_tokens"),
    )
    rest = pieces.where((F.col("n_tokens") < largest) & (F.col("n_tokens") > 0)).select(*columns, F.col("_n").alias("_whole"), "_nth", F.pmod(F.xxhash64("_id", "_n", "_nth", "piece_no"), F.lit(shards)).alias("_shard"))
    kind = items.schema[item_id].dataType.simpleString()
    packed = rest.groupBy("_shard").applyInPandas(_packer(tuple(capacities), opening_cost), f"_id {kind}, piece_no int, n_pieces int, start_token bigint, n_tokens bigint, container string, capacity bigint, container_tokens bigint")
    return alone.unionByName(packed).withColumnRenamed("_id", item_id)
