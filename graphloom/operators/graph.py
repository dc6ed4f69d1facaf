"""Graph kernels: loops over frontiers, each level one join and one anti-join.

Frontiers and visited sets are tables; lineage is cut at each level. Loops end
with an empty frontier or the given depth.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize

#: Distinct edges that betweenness sends to the tasks.
LOCAL_EDGES = 200_000
IMPACT_BACK, IMPACT_FORTH = ["calls", "tests", "depends_on"], ["writes", "publishes", "owns"]


def impact_steps(edges: DataFrame) -> DataFrame:
    """(at, to): where a change at a node is felt next."""
    back = edges.where(F.col("kind").isin(IMPACT_BACK)).select(F.col("target").alias("at"), F.col("source").alias("to"))
    forth = edges.where(F.col("kind").isin(IMPACT_FORTH)).select(F.col("source").alias("at"), F.col("target").alias("to"))
    return back.union(forth).distinct()


def bounded_search(steps: DataFrame, roots: DataFrame, depth: int | None = None, together: bool = False) -> DataFrame:
    """(root, node, hop): least number of steps from each root, the root included with 0.

    With ``together`` from any of the roots, ``root`` being null-free but without
    a meaning: each node is there once.
    """
    root = F.lit("") if together else F.col("id")
    frontier = materialize(roots.select(root.alias("root"), F.col("id").alias("node")).distinct().withColumn("hop", F.lit(0)))
    seen, level = frontier, 0
    while depth is None or level < depth:
        level += 1
        reached = frontier.join(steps, frontier["node"] == steps["at"]).select("root", F.col("to").alias("node")).distinct()
        fresh = reached.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        frontier = materialize(fresh.withColumn("hop", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def impact(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, node, hop) within ``depth`` (at least 1), over known nodes."""
    ids = nodes.select(F.col("id").alias("to"))
    steps = materialize(impact_steps(edges).join(ids, "to", "left_semi").select("at", "to"))
    return bounded_search(steps, roots, max(1, depth))


def induced_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges both ends of which are among ``node``."""
    ids = visible.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "source"), "source", "left_semi").join(ids.withColumnRenamed("node", "target"), "target", "left_semi").select(edges.columns)


def covered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): what some test reaches over calls and tests, tests left out; a row a node, whatever the number of tests."""
    steps = materialize(edges.where("kind in ('calls', 'tests')").select(F.col("source").alias("at"), F.col("target").alias("to")).distinct())
    return bounded_search(steps, nodes.where("kind = 'test'").select("id"), together=True).where("hop > 0").select("node")


def closure(pairs: DataFrame) -> DataFrame:
    """(u, v): v is reached from u in one step or more.

    Each round joins the newest pairs with all known ones, so distances double
    and the rounds are the logarithm of the longest distance.
    """
    frontier = seen = materialize(pairs.select("u", "v").distinct())
    while True:
        known = seen.select(F.col("u").alias("v"), F.col("v").alias("w"))
        fresh = frontier.join(known, "v").select("u", F.col("w").alias("v")).distinct().join(seen, ["u", "v"], "left_anti")
        frontier = materialize(fresh)
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def components_of(reach: DataFrame) -> DataFrame:
    """(node, component, size) of strongly connected components of two or more, from a closure."""
    back = reach.select(F.col("v").alias("u"), F.col("u").alias("v"))
    mutual = reach.join(back, ["u", "v"], "left_semi")
    named = mutual.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component"), F.count_distinct("v").alias("size"))
    return named.where("size > 1")


def transitive_dependents(reach: DataFrame, packages: DataFrame) -> DataFrame:
    counts = reach.where("u <> v").groupBy(F.col("v").alias("id")).agg(F.count("*").alias("transitive"))
    return packages.select("id").join(counts, "id", "left").na.fill(0, ["transitive"])


def reach_evidence(edges: DataFrame, units: DataFrame, most: int = 50) -> DataFrame:
    """(id, place, edge): the first ``most`` edges that show what depends on each unit, in the order of a search.

    edges: id, u, v, as of ``facts.unit_edges``. A search takes units level by level, those
    that lead to the same level by the order of what they were found from, then by id, and of
    each unit its incoming edges by id. A unit without incoming edges shows none and leads
    nowhere, and one with any shows one at least: so of a level no more units are kept than
    edges are wanted yet, and searches that have them all end.
    """
    arcs = materialize(edges.select("id", "u", "v").where("u <> v").distinct(), "arcs")
    shown = arcs.groupBy(F.col("v").alias("node")).agg(F.count_distinct("id").alias("n"))
    steps = materialize(arcs.select(F.col("v").alias("at"), F.col("u").alias("to")).distinct().join(shown.withColumnRenamed("node", "to"), "to", "left"), "steps")
    front = materialize(units.select("id").join(shown, units["id"] == shown["node"]).select("id", "node", F.lit(0).alias("level"), F.lit(1).alias("rank"), "n"), "front")
    seen = front
    while True:
        told = seen.groupBy("id").agg(F.sum("n").alias("told")).where(F.col("told") < most)
        met = front.join(told, "id").join(steps.withColumnRenamed("n", "m"), front["node"] == F.col("at")).where("to <> id and m is not null")
        found = met.groupBy("id", F.col("to").alias("node")).agg(F.min("rank").alias("by"), F.first("m").alias("n"), F.first("level").alias("level"), F.first("told").alias("told"))
        fresh = found.join(seen.select("id", "node"), ["id", "node"], "left_anti")
        ranked = fresh.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("by", "node")))
        front = materialize(ranked.where(F.col("rank") <= most).where(f"rank <= {most} - told").select("id", "node", (F.col("level") + 1).alias("level"), "rank", "n"), "front")
        if front.isEmpty():
            break
        seen = seen.union(front)
    of_unit = Window.partitionBy("v").orderBy("id")
    first = arcs.select("v", "id").distinct().withColumn("own", F.row_number().over(of_unit)).where(F.col("own") <= most).select(F.col("v").alias("node"), F.col("id").alias("edge"))
    order = Window.partitionBy("id").orderBy("level", "rank", "edge")
    return seen.join(first, "node").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("id", "place", "edge")


def dependency_depth(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Least hops from a node without incoming edges; null where none leads."""
    steps = materialize(pairs.select(F.col("u").alias("at"), F.col("v").alias("to")).distinct())
    roots = nodes.join(steps.select(F.col("to").alias("id")), "id", "left_anti").select("id")
    least = bounded_search(steps, roots).groupBy(F.col("node").alias("id")).agg(F.min("hop").alias("depth"))
    return nodes.select("id").join(least, "id", "left")


def betweenness(pairs: DataFrame, nodes: DataFrame, most: int = 64, spaced: bool = True, multiple: bool = False) -> DataFrame:
    """(id, score): shortest-path betweenness from at most ``most`` sources, over its maximum.

    With ``spaced`` the sources lie evenly among the sorted ids, else they are
    the first; with ``multiple`` parallel edges count as often as they occur.
    Up to LOCAL_EDGES distinct edges are sent to the tasks, each of which takes
    some sources; larger graphs are walked level by level as tables: forth to
    count shortest paths, back to gather dependencies.
    """
    weights = pairs.groupBy("u", "v").agg(F.count("*").alias("w") if multiple else F.lit(1).cast("long").alias("w"))
    steps = materialize(weights)
    sources = _spaced(nodes, most) if spaced else [r["id"] for r in nodes.select("id").orderBy("id").limit(most).collect()]
    spark = nodes.sparkSession
    if steps.count() <= LOCAL_EDGES:
        return _scaled(_raw_by_source(steps, sources), nodes)
    frontier = spark.createDataFrame([(s,) for s in sources], "s string").select("s", F.col("s").alias("node"), F.lit(1.0).alias("sigma"), F.lit(0).alias("dist"))
    levels = [materialize(frontier)]
    seen = levels[0]
    while True:
        last = levels[-1]
        step = last.join(steps, last["node"] == steps["u"]).groupBy("s", F.col("v").alias("node")).agg(F.sum(F.col("sigma") * F.col("w")).alias("sigma"))
        fresh = materialize(step.join(seen.select("s", "node"), ["s", "node"], "left_anti").withColumn("dist", F.lit(len(levels))))
        if fresh.isEmpty():
            break
        levels.append(fresh)
        seen = seen.union(fresh)
    gathered = materialize(levels[-1].select("s", "node", "sigma", F.lit(0.0).alias("delta")))
    parts = [gathered]
    for level in reversed(levels[:-1]):
        after = gathered.select("s", F.col("node").alias("v"), F.col("sigma").alias("sigma_v"), "delta")
        share = level.join(steps, level["node"] == steps["u"]).join(after, ["s", "v"]).groupBy("s", "node").agg(F.sum(F.col("sigma") * F.col("w") / F.col("sigma_v") * (1 + F.col("delta"))).alias("delta"))
        gathered = materialize(level.select("s", "node", "sigma").join(share, ["s", "node"], "left").na.fill(0.0, ["delta"]))
        parts.append(gathered)
    total = parts[0]
    for part in parts[1:]:
        total = total.union(part)
    return _scaled(total.where("s <> node").groupBy(F.col("node").alias("id")).agg(F.sum("delta").alias("raw")), nodes)


def _scaled(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Scores over their maximum, 0 for nodes without one."""
    rows = materialize(nodes.select("id").join(raw, "id", "left").na.fill(0.0, ["raw"]))
    top = rows.agg(F.max("raw")).collect()[0][0] or 0.0
    return rows.select("id", (F.col("raw") / top if top > 0 else F.lit(0.0)).alias("score"))


def _raw_by_source(steps: DataFrame, sources: list[str]) -> DataFrame:
    """(id, raw): dependencies summed over sources, with the edges in each task's memory."""
    ways: dict[str, list[tuple[str, float]]] = {}
    for r in steps.collect():  # at most LOCAL_EDGES rows
        ways.setdefault(r["u"], []).append((r["v"], float(r["w"])))
    shared = steps.sparkSession.sparkContext.broadcast(ways)

    def read(batches):
        total: dict[str, float] = {}
        for source in (s for batch in batches for s in batch["s"]):
            for node, x in dependencies(shared.value, source).items():
                total[node] = total.get(node, 0.0) + x
        if total:
            yield pd.DataFrame({"id": list(total), "raw": list(total.values())})

    spread = steps.sparkSession.createDataFrame([(s,) for s in sources], "s string").repartition(max(1, min(16, len(sources))))
    return spread.mapInPandas(read, "id string, raw double").groupBy("id").agg(F.sum("raw").alias("raw"))


def dependencies(ways: dict[str, list[tuple[str, float]]], source: str) -> dict[str, float]:
    """How much of the shortest paths from ``source`` passes each node."""
    layers, sigma, dist = [[source]], {source: 1.0}, {source: 0}
    while layers[-1]:
        depth, after = len(layers), []
        for node in layers[-1]:
            for to, weight in ways.get(node, ()):
                if dist.setdefault(to, depth) == depth:
                    if to not in sigma:
                        after.append(to)
                    sigma[to] = sigma.get(to, 0.0) + sigma[node] * weight
        layers.append(after)
    found: dict[str, float] = {}
    for depth in range(len(layers) - 1, 0, -1):
        for node in layers[depth - 1]:
            share = sum(sigma[node] * w / sigma[to] * (1 + found.get(to, 0.0)) for to, w in ways.get(node, ()) if dist[to] == depth)
            found[node] = share
    found.pop(source, None)
    return found


def _spaced(nodes: DataFrame, most: int) -> list[str]:
    """At most ``most`` ids, evenly spaced by rank; the first and the last are among them."""
    total = nodes.count()
    if total <= most:
        return sorted(r["id"] for r in nodes.select("id").collect())
    ordered = materialize(nodes.select("id").repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id()))
    counts = {r["p"]: r["count"] for r in ordered.groupBy(F.shiftright("at", 33).alias("p")).count().collect()}
    before, at = {}, 0
    for p in sorted(counts):
        before[p], at = at, at + counts[p]
    wanted = []
    for i in range(most):
        rank = i * (total - 1) // (most - 1)
        p = max(q for q in before if before[q] <= rank)
        wanted.append((p << 33) + rank - before[p])
    return [r["id"] for r in ordered.where(F.col("at").isin(wanted)).orderBy("id").collect()]
