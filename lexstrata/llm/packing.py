"""Filling containers of fixed capacity: Karmarkar-Karp multiway differencing.

Items are spread over shards of about SHARD_WINDOWS containers' worth by a hash of their id and size and, of equal ones, of
the block of TOGETHER of them they are counted into, so no id and no size gathers in one shard. In a shard each item begins as
a partition into k windows, k being the least number that could hold all: its size in one window, nothing in the others. The two
partitions with the greatest spread (largest less smallest window) are merged with opposing imbalances, the fullest
window of one with the emptiest of the other, until one partition is left: k nearly equal windows. If a window
exceeds the capacity and no move or swap of single items relieves it, k rises and the shard is packed anew.

Only ids and sizes move, equal ones as one row and their number. An item above the capacity is cut into full containers and a rest; the rest is packed like an item.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 8192
SHARD_WINDOWS = 128
SHARD_ITEMS = 8_192
SHARDS_A_TASK = 256
TOGETHER = 16  # equal items that stay together
PACK_SCHEMA = "container_id string, item_id long, piece_no int, first_unit long, units long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k windows of item indexes whose sums are as near to equal as multiway differencing makes them.

    A partition is kept as its windows above its emptiest one: (excess, items) in falling order, absent ones being
    equal to the emptiest. Equal spreads are merged in order of age, so the result depends on the sizes' order only.
    """
    if not sizes:
        return [[] for _ in range(k)]
    heap = [(-s, i, [(s, [i])], []) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    age = len(sizes)
    while len(heap) > 1:
        _, _, a, a_low = heapq.heappop(heap)
        _, _, b, b_low = heapq.heappop(heap)
        merged, low = _merge(a, a_low, b, b_low, k)
        heapq.heappush(heap, (-(merged[0][0] if merged else 0), age, merged, low))
        age += 1
    _, _, windows, low = heap[0]
    out = [items for _, items in windows] + low
    return out + [[] for _ in range(k - len(out))]


def _merge(a, a_low, b, b_low, k):
    """a's fullest window with b's emptiest and so on. *_low: item lists of windows that stand at the zero level."""
    if not a_low and not b_low and len(a) + len(b) <= k:  # enough empty windows on both sides: nothing is added up
        merged = sorted(a + b, key=lambda x: -x[0])
        if len(merged) < k:
            return merged, []
    else:
        down = [*a, *((0, i) for i in a_low), *((0, []) for _ in range(k - len(a) - len(a_low)))]
        up = [*b, *((0, i) for i in b_low), *((0, []) for _ in range(k - len(b) - len(b_low)))]
        merged = sorted(((x + y, i + j) for (x, i), (y, j) in zip(down, reversed(up), strict=True)), key=lambda x: -x[0])
    least = merged[-1][0]
    return [(s - least, i) for s, i in merged if s > least], [i for s, i in merged if s == least]


def relieve(windows: list[list[int]], sizes: list[int], capacity: int) -> bool:
    """Move or swap items out of windows above the capacity without filling another above it; whether none is left.

    Each step lowers the total excess, taking the change nearest above the window's excess or else the largest.
    """
    size = np.array([*sizes, 0], np.int64)
    home = np.full(len(sizes), -1)
    for w, window in enumerate(windows):
        home[window] = w
    load = np.array([sum(sizes[i] for i in w) for w in windows], np.int64)
    placed = np.flatnonzero(home >= 0)
    for w in np.flatnonzero(load > capacity):
        while load[w] > capacity:
            own = np.array(windows[w])
            others = placed[home[placed] != w]
            # an own item against each other item, and against each window's free room
            give = size[own][:, None] - np.r_[size[others], np.zeros(len(windows), np.int64)][None, :]
            to = np.r_[home[others], np.arange(len(windows))]
            fits = (give > 0) & (give <= (capacity - load)[to][None, :]) & (to != w)[None, :]
            if not fits.any():
                return False
            enough = fits & (give >= load[w] - capacity)
            i, j = divmod(int(np.argmin(np.where(enough, give, capacity + 1)) if enough.any() else np.argmax(np.where(fits, give, 0))), give.shape[1])
            item, target, moved = int(own[i]), int(to[j]), int(give[i, j])
            windows[w].remove(item)
            windows[target].append(item)
            home[item] = target
            if j < len(others):
                back = int(others[j])
                windows[target].remove(back)
                windows[w].append(back)
                home[back] = w
            load[w] -= moved
            load[target] += moved
    return True


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item indexes, none above the capacity; every size must be within it.

    Items with which not even the smallest other one fits are windows of their own and take no part in the balancing, nor do
    items without any size, which go to the last window.
    """
    order = sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: -sizes[i])
    empty = [i for i in range(len(sizes)) if not sizes[i]]
    alone = []
    while len(alone) < len(order) - 1 and sizes[order[len(alone)]] + sizes[order[-1]] > capacity:
        alone.append(order[len(alone)])
    rest = sorted(order[len(alone) :])
    loose = [sizes[i] for i in rest]
    k = max(1, -(-sum(loose) // capacity))
    while True:
        windows = differencing(loose, k)
        if relieve(windows, loose, capacity):
            out = [[i] for i in alone] + [[rest[i] for i in w] for w in windows if w]
            if empty:
                out = [*out[:-1], (out[-1] if out else []) + empty]
            return out
        k += max(1, k // 400)


def _pack_shard(capacity: int):
    def run(data: pa.Table) -> pa.Table:
        shard = data["shard"][0].as_py()
        data = data.sort_by([("item_id", "ascending"), ("piece_no", "ascending"), ("units", "ascending")])
        data = data.take(np.repeat(np.arange(data.num_rows), data["n"].to_numpy()))
        sizes = data["units"].to_pylist()
        names = [""] * len(sizes)
        for w, window in enumerate(pack(sizes, capacity)):
            for i in window:
                names[i] = f"{shard}-{w}"
        out = data.select(["item_id", "piece_no", "first_unit", "units"])
        return out.add_column(0, "container_id", pa.array(names, pa.string()))

    return run


def fill_containers(items: DataFrame, item_id: str, size: Column, capacity: int = CAPACITY, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """(container_id, item_id, piece_no, first_unit, units): which part of which item each container holds.

    An item is whole (piece_no 1, first_unit 1) unless it is larger than a container. Null sizes count as 0, negative
    ones raise; size 0 takes no room but has a place. Null ids are items; repeated rows are items of their own. One
    aggregate over the sizes (one row to the driver) tells the number of shards; shards then hold about the same load
    and number of items, whatever source, key or id the items come from, be they all of one id or of none.
    """
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    rows = rows.withColumn("size", F.when(F.col("size") >= 0, F.col("size")).otherwise(F.raise_error(F.lit("negative size"))))
    full = F.floor(F.col("size") / capacity).cast("int")
    rest = F.col("size") - F.floor(F.col("size") / capacity) * capacity
    pieces = rows.select("item_id", "size", full.alias("n_full"), rest.alias("rest"))
    whole = pieces.where(F.col("n_full") > 0).select("item_id", F.explode(F.sequence(F.lit(1), F.col("n_full"))).alias("piece_no"))
    whole = whole.select(
        F.concat(F.lit("full-"), F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.lit("-"), F.col("piece_no").cast("string")).alias("container_id"),
        "item_id", "piece_no", ((F.col("piece_no") - 1).cast("long") * capacity + 1).alias("first_unit"), F.lit(capacity).cast("long").alias("units"),
    )
    loose = pieces.where((F.col("rest") > 0) | (F.col("n_full") == 0)).select("item_id", (F.col("n_full") + 1).alias("piece_no"), (F.col("size") - F.col("rest") + 1).alias("first_unit"), F.col("rest").alias("units"))
    total = loose.agg(F.sum("units"), F.count(F.lit(1))).first()
    shards = int(max(1, (total[0] or 0) // (capacity * shard_windows), (total[1] or 0) // SHARD_ITEMS))
    # Little data but much computing a shard: the number of tasks follows the shards, not the bytes that adaptive execution would go by.
    tasks = min(shards, max(4 * items.sparkSession.sparkContext.defaultParallelism, shards // SHARDS_A_TASK))
    # Equal rows are told apart by nothing but their number; so a hot id is a row for each of its sizes before it is spread.
    same = loose.groupBy("item_id", "piece_no", "first_unit", "units").agg(F.count(F.lit(1)).alias("n"))
    # in two steps, so that no array grows with the data
    last = F.floor((F.col("n") - 1) / TOGETHER)
    far = same.withColumn("far", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(last, 16))))
    blocks = far.withColumn("block", F.explode(F.sequence(F.shiftleft("far", 16), F.least(last, F.shiftleft("far", 16) + 65535)))).drop("far")
    blocks = blocks.withColumn("n", F.least(F.lit(TOGETHER), F.col("n") - F.col("block") * TOGETHER))
    placed = blocks.withColumn("shard", F.pmod(F.xxhash64("item_id", "piece_no", "units", "block", F.lit("shard")), F.lit(shards))).drop("block").repartition(tasks, "shard")
    return placed.groupBy("shard").applyInArrow(_pack_shard(capacity), PACK_SCHEMA).unionByName(whole)
