"""Minimum-cost-flow resharding."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest flow of all ``supply`` into ``capacity`` (as large in sum): amounts by (source, sink).

    Successive shortest paths with potentials over the bipartite graph; ``cost(i, j)`` is a small integer.
    """
    n, m = len(supply), len(capacity)
    left, room, flow = list(supply), list(capacity), defaultdict(int)
    price = [0] * (n + m)
    while any(left):
        distance, before = [float("inf")] * (n + m), [-1] * (n + m)
        queue = []
        for i in range(n):
            if left[i]:
                distance[i] = 0
                queue.append((0, i))
        heapq.heapify(queue)
        while queue:
            d, u = heapq.heappop(queue)
            if d > distance[u]:
                continue
            edges = ((n + j, cost(u, j)) for j in range(m)) if u < n else ((i, -cost(i, u - n)) for i in range(n) if flow[i, u - n])
            for v, c in edges:
                step = d + c + price[u] - price[v]
                if step < distance[v]:
                    distance[v], before[v] = step, u
                    heapq.heappush(queue, (step, v))
        ends = [n + j for j in range(m) if room[j] and distance[n + j] < float("inf")]
        goal = min(ends, key=lambda v: distance[v] + price[v])
        bound = distance[goal]
        price = [p + min(d, bound) for p, d in zip(price, distance)]
        path, v = [goal], goal
        while before[v] >= 0:
            v = before[v]
            path.append(v)
        amount = min(left[v], room[goal - n])
        steps = list(zip(path[1:], path))
        for a, b in steps:
            if a >= n:
                amount = min(amount, flow[b, a - n])
        for a, b in steps:
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[v] -= amount
        room[goal - n] -= amount
    return {k: x for k, x in flow.items() if x}


def plan_blocks(blocks: list[tuple[int, int | tuple, int]], n_new: int) -> dict[tuple[int, int | tuple], int]:
    """New shard of each block (old shard, number or place, bytes): near-equal shards that keep as many bytes as they can.

    The flow says how many bytes each old shard sends where; an old shard's home is the new shard of the same
    number. Blocks then fill those amounts in order, so that what stays fills whole files, and single blocks move
    or change places between the fullest and the emptiest shard as long as that brings the two closer together.
    """
    total = sum(b[2] for b in blocks)
    capacity = [total * (j + 1) // n_new - total * j // n_new for j in range(n_new)]
    olds = sorted({b[0] for b in blocks})
    supply = [sum(size for o, _, size in blocks if o == old) for old in olds]
    wanted = min_cost_flow(supply, capacity, lambda i, j: 0 if olds[i] == j else 1)
    need = {(olds[i], j): x for (i, j), x in wanted.items()}
    by_old = defaultdict(list)
    for (o, j) in need:
        by_old[o].append(j)
    placed, held, load = {}, defaultdict(list), [0] * n_new
    for o, b, size in sorted(blocks, key=lambda x: (x[0], x[1])):
        home = (o, o) in need and 2 * need[o, o] >= size
        j = o if home else max(by_old[o], key=lambda j: (need[o, j], -j)) if by_old[o] else min(range(n_new), key=lambda j: (load[j], j))
        if by_old[o]:
            need[o, j] -= size
        placed[o, b] = j
        load[j] += size
        held[j].append((size, o, b))
    while True:  # each move or exchange lessens the sum of squared loads, so this ends
        high, low = max(range(n_new), key=lambda j: load[j]), min(range(n_new), key=lambda j: load[j])
        gap = load[high] - load[low]
        best = None
        for x in held[high]:
            if 0 < x[0] < gap and (best is None or abs(gap - 2 * x[0]) < abs(gap - 2 * best[0])):
                best = x
        swap = None
        if best is None or abs(gap - 2 * best[0]) > gap // 8:
            small = sorted(held[low])
            for x in held[high]:
                goal = x[0] - gap / 2
                for y in small[max(0, _place(small, goal) - 1) : _place(small, goal) + 1]:
                    shift = x[0] - y[0]
                    if 0 < shift < gap and (swap is None or abs(gap - 2 * shift) < abs(gap - 2 * (swap[0][0] - swap[1][0]))):
                        swap = (x, y)
        moves = []
        if swap and (best is None or abs(gap - 2 * (swap[0][0] - swap[1][0])) < abs(gap - 2 * best[0])):
            moves = [(swap[0], high, low), (swap[1], low, high)]
        elif best:
            moves = [(best, high, low)]
        if not moves:
            break
        for x, a, b in moves:
            held[a].remove(x)
            held[b].append(x)
            placed[x[1], x[2]] = b
            load[a] -= x[0]
            load[b] += x[0]
    return placed


def _place(ordered: list[tuple[int, int, int]], size: float) -> int:
    return bisect_left(ordered, (size,))


def _own_names(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns if c not in ("size", "shard", "slot", "moved")]


def reshard(docs: DataFrame, old_shard: Callable[[Column, Column], Column], n_new: int, out: str, blocks_per_shard: int = 128, stretches: int = 1) -> DataFrame:
    """Move a table of Parquet files, ``docs`` as read from them, from its shards to ``n_new`` of near-equal bytes.

    Each file is cut into ceil(``stretches`` / number of files) stretches of rows, so into one where there are as many files.
    ``old_shard`` makes of the path of a row's file and the number of its stretch (from 0) the number of its shard. A block is a
    run of rows of one stretch, about 1/``blocks_per_shard`` of a new shard or a whole small stretch; the plan works on block sizes
    (about ``n_new * blocks_per_shard`` numbers and one more a stretch, however large the table) and moves the fewest bytes
    that even the shards out. Stretches of which no block leaves its shard stay as they are; of the others the rows are
    written anew under ``out``, in their shard's folder. A row's slot follows from its block's base and its place in
    the file, so nothing is sorted or shuffled, and equal rows are told apart. Old shards are sources of the flow, which takes
    (old + new) * old * new steps on the driver: some hundreds of each.

    Returns all columns of ``docs`` (but for those named like the new ones) with ``size`` (bytes of ``text`` and 16
    for the row), ``shard``, ``slot`` (gapless from 0) and ``moved``. Null text has no bytes; null doc_ids and
    repeated rows stay; a null old shard counts as one of its own; an empty table gives none; a table that is no scan of files
    is a ValueError.
    """
    spark = docs.sparkSession
    try:
        meta = docs.metadataColumn("_metadata")
        named = docs.select(F.struct(*_own_names(docs)).alias("row"), (F.octet_length(text_or_empty()) + 16).cast("long").alias("size"), meta["file_path"].alias("file"), meta["row_index"].alias("at"))
    except AnalysisException as error:
        raise ValueError("resharding works on a table as read from its files") from error
    sizes = materialize(named.select("file", "at", "size"), f"{out}/sizes")
    files = materialize(sizes.groupBy("file").agg(F.count("*").alias("n")), f"{out}/files")
    pieces = max(1, math.ceil(stretches / max(1, files.count())))
    long = F.ceil(F.col("n") / pieces).cast("long")
    files = files.select("file", long.alias("long"))
    stretch = F.floor(F.col("at") / F.col("long")).cast("long").alias("stretch")
    own = sizes.join(files, "file").select("file", stretch, "long", "at", "size")
    units = own.groupBy("file", "stretch", "long").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total = units.agg(F.sum("bytes")).first()[0] or 0
    share = F.greatest(F.lit(1), F.ceil(F.col("bytes") * n_new * blocks_per_shard / F.lit(max(total, 1)))).cast("long")
    shard = F.coalesce(old_shard(F.col("file"), F.col("stretch")).cast("int"), F.lit(-1)).alias("old_shard")
    units = materialize(units.select("file", "stretch", "long", shard, F.ceil(F.col("n") / share).cast("long").alias("rows")), f"{out}/stretches")
    block = F.floor((F.col("at") - F.col("stretch") * F.col("long")) / F.col("rows")).cast("long").alias("block")
    blocks = own.join(units.drop("long"), ["file", "stretch"]).groupBy("old_shard", "file", "stretch", block).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    blocks = materialize(blocks, f"{out}/blocks")
    listed = blocks.select("old_shard", "file", "stretch", "block", "bytes").collect()
    placed = plan_blocks([(b.old_shard, (b.file, b.stretch, b.block), b.bytes) for b in listed], n_new) if listed else {}
    plan = spark.createDataFrame([(*key, j) for (_, key), j in placed.items()], "file string, stretch long, block long, shard int")
    before = Window.partitionBy("shard").orderBy("file", "stretch", "block").rowsBetween(Window.unboundedPreceding, -1)
    placement = blocks.join(plan, ["file", "stretch", "block"]).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placement = placement.withColumn("affected", F.max(F.col("shard") != F.col("old_shard")).over(Window.partitionBy("file", "stretch")))
    placement = materialize(placement.select("file", "stretch", "block", "old_shard", "shard", "base", "affected"), f"{out}/placement")
    slot = F.col("base") + F.col("at") - F.col("stretch") * F.col("long") - F.col("block") * F.col("rows")
    moved = F.col("shard") != F.col("old_shard")
    rows = named.join(files, "file").withColumn("stretch", stretch).join(units.drop("long", "old_shard"), ["file", "stretch"])
    rows = rows.withColumn("block", block).join(placement, ["file", "stretch", "block"])
    final = lambda df: df.select("row.*", "size", "shard", slot.alias("slot"), moved.alias("moved"))
    anew = final(rows.where("affected"))
    anew.write.partitionBy("shard").parquet(f"{out}/shards")
    back = spark.read.schema(anew.schema).parquet(f"{out}/shards").select(*anew.columns)
    if placement.where("NOT affected").isEmpty():
        return back
    return back.unionByName(final(rows.where("NOT affected")))
