"""Resharding by minimum-cost flow.

Old shards hold documents in blocks, the partitions of their files; new shards
have capacities in bytes. Moving a byte to another shard costs one unit, leaving
it costs none. The flow between old and new shards that fills the capacities at
the least cost is solved over the shards alone; the rows of an old shard, in the
order of its files, are then cut where the flow says. A cut is found by sums over
blocks, then over the partitions of one block, then along the rows of one
partition, so a plan is a short list of row numbers and no key of the data, however
frequent, gathers rows in a task. Documents that are large against a shard are
placed one by one before, so that cuts stay fine; there are at most ``shards *
large`` of them. Shards that gain or lose rows are then rewritten.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, scratch_path

NEW, OLD, BLOCKS, OVERHEAD = 24, 16, 256, 8
#: A document is large if its size is over that share of a new shard's; there are at most NEW * LARGE of them.
LARGE = 32


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from each supply to each capacity, all supplies spent, at the least cost.

    Successive shortest paths with potentials; the capacities must suffice.
    """
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    pot = [0] * (n + m)
    while any(left):
        far, via = [float("inf")] * (n + m), [-1] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        for _, i in heap:
            far[i] = 0
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            steps = ((n + j, cost[u][j]) for j in range(m)) if u < n else ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in steps:
                if (e := d + c + pot[u] - pot[v]) < far[v]:
                    far[v], via[v] = e, u
                    heapq.heappush(heap, (e, v))
        ends = [n + j for j in range(m) if room[j] and far[n + j] < float("inf")]
        if not ends:
            raise ValueError("the capacities do not suffice")
        end = min(ends, key=lambda v: far[v] + pot[v])
        path = [end]
        while via[path[-1]] >= 0:
            path.append(via[path[-1]])
        path.reverse()
        most = min(left[path[0]], room[end - n], *(flow[v][u - n] for u, v in zip(path, path[1:], strict=False) if u >= n), left[path[0]])
        for u, v in zip(path, path[1:], strict=False):
            if u < n:
                flow[u][v - n] += most
            else:
                flow[v][u - n] -= most
        left[path[0]] -= most
        room[end - n] -= most
        reach = max(x for x in far if x < float("inf"))
        pot = [p + min(d, reach) for p, d in zip(pot, far, strict=True)]
    return flow


def place_large(sizes: list[tuple[int, int]], target: float, shards: int) -> tuple[list[int], list[int]]:
    """Shard of each (old shard, size), largest first, and the loads: home if it fits, else the emptiest."""
    loads, where = [0] * shards, [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k][1], k)):
        old, size = sizes[k]
        to = old if old < shards and loads[old] + size <= target else min(range(shards), key=lambda j: (loads[j], j))
        where[k] = to
        loads[to] += size
    return where, loads


def capacities(loads: list[int], total: int) -> list[int]:
    """Room that levels the loads: ``total`` bytes more in all."""
    low = sorted(loads)
    level, rest = 0, total
    for k, x in enumerate(low):
        nxt = low[k + 1] if k + 1 < len(low) else None
        if nxt is None or (nxt - x) * (k + 1) >= rest:
            level, extra = x + rest // (k + 1), rest % (k + 1)
            break
        rest -= (nxt - x) * (k + 1)
    room = [max(0, level - x) for x in loads]
    for j in sorted((j for j, x in enumerate(loads) if x <= level))[:extra]:
        room[j] += 1
    return room


class Plan(NamedTuple):
    shards: int
    #: (old, last row, new): rows of an old shard up to that one, after those of the entry before, lie in a new shard.
    cuts: list[tuple[int, int, int]]
    #: (row, new) of the large documents.
    large: list[tuple[int, int]]
    #: Shards that gain or lose rows.
    affected: list[int]


def laid_out(docs: DataFrame, old: Column, columns: list[str] | None = None) -> DataFrame:
    """The present files: row (a number, rising within a partition), old, size and the columns of ``docs`` (or some) as c0, c1, ...

    Rows are told apart by their number alone, so null, repeated and clashing
    values of any column do no harm. Sizes are UTF-8 bytes of ``text`` plus 8, a
    null text having none.
    """
    inner = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns or docs.columns)]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(old, F.lit(0)).cast("int").alias("old"), size.alias("size"), *inner)
    path = scratch_path(docs.sparkSession, "present")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def _within(cuts: list[tuple[int, int]], sums: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(cut, part, rest) of each (cut, bytes before it): the part of (part, bytes) where it falls, and the bytes before it there."""
    out, at, k = [], 0, 0
    for cut, before in sorted(cuts, key=lambda c: c[1]):
        while k + 1 < len(sums) and at + sums[k][1] <= before:
            at += sums[k][1]
            k += 1
        out.append((cut, sums[k][0], before - at))
    return out


def plan(held: DataFrame, shards: int = NEW, large: int = LARGE) -> Plan:
    """The cheapest way from the present files ``held`` (see ``laid_out``) to ``shards`` shards of equal bytes."""
    spark = held.sparkSession
    pid = F.shiftright("row", 33)
    told = held.agg(F.sum("size").alias("bytes"), F.max("old").alias("old"), F.max(pid).alias("pid")).collect()[0]
    total, olds, parts = told["bytes"] or 0, (told["old"] or 0) + 1, (told["pid"] or 0) + 1
    bound = total / shards / large
    heavy = held.where(F.col("size") > bound).select("row", "old", "size").orderBy("row").collect()  # at most shards * large rows
    where, loads = place_large([(r["old"], r["size"]) for r in heavy], total / shards, shards)
    block = F.floor(pid * BLOCKS / parts).cast("int") if parts > BLOCKS else pid.cast("int")
    small = held.where(F.col("size") <= bound).select("row", "old", "size", pid.alias("pid"), block.alias("block"))
    sums: dict[int, list[tuple[int, int]]] = {i: [] for i in range(olds)}
    for r in small.groupBy("old", "block").agg(F.sum("size").alias("bytes")).orderBy("old", "block").collect():  # at most olds * BLOCKS rows
        sums[r["old"]].append((r["block"], r["bytes"]))
    supply = [sum(x for _, x in sums[i]) for i in range(olds)]
    flow = min_cost_flow(supply, capacities(loads, sum(supply)), [[int(i != j) for j in range(shards)] for i in range(olds)])

    # (old, cut) to its new shard and place; the last cut of an old shard is open
    to, places = {}, {}
    for i in range(olds):
        at, order = 0, sorted((j for j in range(shards) if flow[i][j]), key=lambda j: (j != i, j))
        for k, j in enumerate(order):
            at += flow[i][j]
            to[i, k] = j
            if k + 1 < len(order):
                places.setdefault(i, []).append((k, at))
    found = [(i, k, b, rest) for i, cuts in places.items() for k, b, rest in _within(cuts, sums[i])]
    if parts > BLOCKS and found:
        chosen = spark.createDataFrame(sorted({(i, b) for i, _, b, _ in found}), "old int, block int")
        fine: dict[tuple[int, int], list[tuple[int, int]]] = {}
        rows = small.join(F.broadcast(chosen), ["old", "block"]).groupBy("old", "block", "pid").agg(F.sum("size").alias("bytes"))
        for r in rows.orderBy("old", "block", "pid").collect():  # the partitions of the blocks with a cut
            fine.setdefault((r["old"], r["block"]), []).append((r["pid"], r["bytes"]))
        blocks: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, k, b, rest in found:
            blocks.setdefault((i, b), []).append((k, rest))
        found = [(i, k, p, rest) for (i, b), cuts in blocks.items() for k, p, rest in _within(cuts, fine[i, b])]
    stops = {}
    if found:
        wanted = spark.createDataFrame([(i, k, p, float(rest)) for i, k, p, rest in found], "old int, cut int, pid long, rest double")
        ahead = F.sum("size").over(Window.partitionBy("old", "pid").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        lines = small.join(F.broadcast(wanted.select("old", "pid").distinct()), ["old", "pid"]).withColumn("middle", ahead - F.col("size") / 2)
        cut = lines.join(F.broadcast(wanted), ["old", "pid"]).groupBy("old", "cut", "pid").agg(F.max(F.when(F.col("middle") < F.col("rest"), F.col("row"))).alias("stop"))
        stops = {(r["old"], r["cut"]): (r["pid"] << 33) - 1 if r["stop"] is None else r["stop"] for r in cut.collect()}
    cuts = [(i, stops.get((i, k), (1 << 63) - 1), j) for (i, k), j in sorted(to.items())]
    placed = list(zip([r["row"] for r in heavy], where, strict=True))
    changed = {x for i, _, j in cuts if i != j for x in (i, j)} | {x for r, j in zip(heavy, where, strict=True) if r["old"] != j for x in (r["old"], j)}
    return Plan(shards, cuts, placed, sorted(changed))


def assigned(held: DataFrame, planned: Plan) -> DataFrame:
    """``held`` with the new shard of each row. Both tables that are joined are bounded by the number of shards."""
    spark = held.sparkSession
    cuts: dict[int, list[tuple[int, int]]] = {}
    for i, stop, j in planned.cuts:
        cuts.setdefault(i, []).append((stop, j))
    by_old = spark.createDataFrame([(i, x) for i, x in cuts.items()], "old int, cuts array<struct<stop: long, to: int>>")
    large = spark.createDataFrame(planned.large, "row long, placed int")
    told = held.join(F.broadcast(by_old), "old", "left").join(F.broadcast(large), "row", "left")
    shard = F.coalesce("placed", F.filter("cuts", lambda c: F.col("row") <= c["stop"])[0]["to"])
    return told.withColumn("shard", shard).select(*held.columns, "shard")


def rewrite(held: DataFrame, planned: Plan, path: str) -> DataFrame:
    """Rewrite the affected shards under the new folder ``path``; the rows of all shards as they lie then.

    Shards that neither gain nor lose rows keep their present files and are read
    from these. A shard's files are balanced by size. Nothing is overwritten: a
    folder that exists is an error.
    """
    rows = assigned(held, planned)
    moved = F.col("shard").isin(planned.affected) if planned.affected else F.lit(False)
    rows.where(moved).hint("rebalance", "shard").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    told = held.sparkSession.read.schema(rows.schema).parquet(path).select(rows.columns)
    return told.union(rows.where(~moved))


def slotted(rows: DataFrame) -> DataFrame:
    """``rows`` (row, shard, ...) with the place of each in its shard, gapless from 0, by row."""
    placed = rows.withColumn("pid", F.shiftright("row", 33))
    runs = placed.groupBy("shard", "pid").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = runs.select("shard", "pid", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "pid").orderBy("row"))
    told = placed.withColumn("within", within).join(offsets, ["shard", "pid"])
    return told.withColumn("slot", (F.col("before") + F.col("within") - 1).cast("long")).select(*rows.columns, "slot")


def reshard(docs: DataFrame, old: Column, shards: int = NEW, path: str | None = None) -> DataFrame:
    """Rows of ``docs`` with shard and slot (both of those names, after the columns), read from the resharded files.

    ``old`` is the present shard, an integer from 0; null counts as 0. New shards
    differ by little more than a large document's bound; of repeated rows each is
    placed for itself. Columns may have any names but those two. An empty table
    gives an empty result.
    """
    held = laid_out(docs, old)
    lying = slotted(rewrite(held, plan(held, shards), path or scratch_path(docs.sparkSession, "resharded")))
    return lying.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], "shard", "slot")


def op5(docs: DataFrame) -> DataFrame:
    """Documents that lie in 16 shards by source, resharded into 24 of equal bytes; sizes and sums are of the texts read back."""
    held = laid_out(docs, F.pmod(F.xxhash64("source"), F.lit(OLD)).cast("int"), ["doc_id", "text"])
    lying = rewrite(held, plan(held), scratch_path(docs.sparkSession, "resharded"))
    text = F.coalesce("c1", F.lit(""))
    told = lying.select("row", "shard", F.col("c0").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    told = slotted(materialize(told, "lying"))
    return told.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
