"""Abstraction, structural metrics, hotspots and architecture evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from . import cycles, graph

# Edge kinds of structural metrics.
STRUCTURAL = ["calls", "depends_on", "implements", "reads", "writes", "publishes", "consumes", "retries"]


def representatives(nodes: DataFrame, level: str) -> DataFrame:
    """(node, rep): what stands for a node at level symbol, package, component or service.

    A node whose package, component or service is not a known node stands for itself.
    """
    rows = nodes.withColumn("rep", F.col("id"))
    if level == "symbol":
        return rows.select(F.col("id").alias("node"), "rep")
    if level == "service":
        want = F.when(F.col("kind") != "service", F.col("service"))
    else:
        want = F.when(~F.col("kind").isin("package", "service"), F.col("pkg"))
        if level == "component" and "component" in nodes.columns:
            known = nodes.select(F.col("id").alias("component"))
            fit = rows.join(known.withColumn("has", F.lit(True)), "component", "left")
            rows, want = fit, F.when(F.col("has"), F.col("component")).otherwise(want)
    known = nodes.select(F.col("id").alias("want"), F.lit(True).alias("known"))
    return rows.withColumn("want", want).join(known, "want", "left").select(F.col("id").alias("node"), F.when(F.col("known"), F.col("want")).otherwise(F.col("id")).alias("rep"))


def mixed_representatives(nodes: DataFrame, branch: str, level: str, detail: str) -> DataFrame:
    """As ``representatives`` at ``level``, but at ``detail`` below the representative ``branch``."""
    fine = representatives(nodes, detail).withColumnRenamed("rep", "fine")
    return representatives(nodes, level).join(fine, "node").select("node", F.when(F.col("rep") == branch, F.col("fine")).otherwise(F.col("rep")).alias("rep"))


def fold(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """One edge per (source, kind, target) of representatives, without loops; the first member's label, and how many there are."""
    source, target = reps.select(F.col("node").alias("source"), F.col("rep").alias("s")), reps.select(F.col("node").alias("target"), F.col("rep").alias("t"))
    told = edges.select("source", "kind", "target", "label", "observations").join(source, "source").join(target, "target").where("s <> t")
    # a label is told of edges of one member only, so no id has to be exchanged
    rows = told.groupBy(F.col("s").alias("source"), "kind", F.col("t").alias("target")).agg(F.min("label").alias("first_label"), F.count("*").alias("members"), F.sum("observations").alias("observations"))
    label = F.when(F.col("members") > 1, F.concat(F.lit("contains "), "members", F.lit(" underlying relationships"))).otherwise(F.col("first_label"))
    return rows.select("source", "kind", "target", label.alias("label"), "members", "observations")


def fold_nodes(reps: DataFrame) -> DataFrame:
    return reps.groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("members"))


def structural_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    kept = edges.where(F.col("kind").isin(STRUCTURAL))
    return kept.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def structural_metrics(edges: DataFrame, nodes: DataFrame, sources: int | None = None) -> DataFrame:
    """Per node: fan_in, fan_out, coupling, boundary_density, and depth and betweenness if ``sources`` is given.

    nodes: id, owner. Counts are of distinct neighbours; the density is the share
    of a node's edges with two owners that differ, of those with two owners.
    """
    kept = materialize(structural_edges(edges, nodes).select("id", "source", "target"))
    own = nodes.select("id", "owner")
    told = kept.join(own.select(F.col("id").alias("source"), F.col("owner").alias("a")), "source").join(own.select(F.col("id").alias("target"), F.col("owner").alias("b")), "target")
    sides = told.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other"), F.lit(True).alias("out")), F.struct(F.col("target").alias("node"), F.col("source").alias("other"), F.lit(False).alias("out")))).alias("x"), "a", "b").select("x.*", "a", "b")
    owned = F.col("a").isNotNull() & F.col("b").isNotNull()
    sums = sides.groupBy(F.col("node").alias("id")).agg(
        F.count_distinct(F.when(~F.col("out"), F.col("other"))).alias("fan_in"), F.count_distinct(F.when(F.col("out"), F.col("other"))).alias("fan_out"), F.count_distinct("other").alias("coupling"),
        F.count_if(owned).alias("owned"), F.count_if(owned & (F.col("a") != F.col("b"))).alias("crossing"),
    )
    rows = nodes.select("id").join(sums, "id", "left").na.fill(0)
    rows = rows.select("id", "fan_in", "fan_out", "coupling", F.when(F.col("owned") > 0, F.col("crossing") / F.col("owned")).otherwise(0.0).alias("boundary_density"))
    if sources is None:
        return rows
    pairs = kept.select(F.col("source").alias("u"), F.col("target").alias("v"))
    between = graph.betweenness(pairs, nodes, sources, spaced=False, multiple=True).withColumnRenamed("score", "betweenness")
    return rows.join(graph.dependency_depth(pairs, nodes), "id", "left").join(between, "id", "left")


def structural_cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, node): strongly connected components of two or more, and nodes with a loop."""
    pairs = structural_edges(edges, nodes).select(F.col("source").alias("u"), F.col("target").alias("v")).distinct()
    return _cycles(pairs)


def flow_cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, node): cycles along the flow of data and control, in which reads and consumption run from the resource."""
    turned = F.col("kind").isin("reads", "consumes")
    kept = structural_edges(edges, nodes).select(F.when(turned, F.col("target")).otherwise(F.col("source")).alias("u"), F.when(turned, F.col("source")).otherwise(F.col("target")).alias("v"))
    return _cycles(kept.distinct())


def _cycles(pairs: DataFrame) -> DataFrame:
    pairs = materialize(pairs)
    big = materialize(cycles.strong_components(pairs).select("component", "node"))
    loops = pairs.where("u = v").select(F.col("u").alias("node")).join(big, "node", "left_anti")
    return big.union(loops.select(F.col("node").alias("component"), "node"))


def hotspots(metrics: DataFrame, complexity: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, score): structural risk; complexity: id, score; changed: id."""
    top = metrics.agg(F.max("coupling")).collect()[0][0] or 0
    rows = metrics.join(complexity.select("id", F.col("score").alias("cx")), "id", "left").join(changed.select("id", F.lit(1.0).alias("hit")), "id", "left")
    hard = F.least(F.lit(1.0), F.coalesce("cx", F.lit(0)) / 10)
    score = F.col("coupling") / max(1, top) * 0.35 + hard * 0.25 + F.coalesce("hit", F.lit(0.0)) * 0.2 + F.col("boundary_density") * 0.1 + F.coalesce("betweenness", F.lit(0.0)) * 0.1
    return rows.select("id", score.alias("score")).orderBy(F.desc("score"), "id")


def evolution(edge_delta: DataFrame, reasons: DataFrame, base: DataFrame, head: DataFrame, base_cycles: DataFrame, head_cycles: DataFrame) -> DataFrame:
    """(id, kind, direction, score) of architecture changes, each id once: the last of the kinds in their order.

    edge_delta: id, status. reasons: id, reason, rises (whether a complexity or
    protection change is for the worse). base and head: id, coupling, of the same
    abstraction. cycles: one ``key`` per cycle.
    """

    def change(rows: DataFrame, id_: Column, kind: str, direction: Column, score: Column) -> DataFrame:
        return rows.select(id_.alias("id"), F.lit(kind).alias("kind"), direction.alias("direction"), score.cast("int").alias("score"))

    new = F.col("status") == "added"
    dependency = change(edge_delta.where("status in ('added', 'removed')"), F.concat(F.lit("dependency:"), "id", F.lit(":"), "status"), "dependency", F.when(new, "introduced").otherwise("removed"), F.when(new, 90).otherwise(65))
    of = lambda reason: reasons.where(F.col("reason") == reason)
    owner = change(of("ownership-changed"), F.concat(F.lit("ownership:"), "id"), "ownership", F.lit("changed"), F.lit(80))
    complex_ = change(of("complexity-changed"), F.concat(F.lit("complexity:"), "id"), "complexity", F.when(F.col("rises"), "increased").otherwise("decreased"), F.when(F.col("rises"), 72).otherwise(35))
    test = change(of("test-protection-changed"), F.concat(F.lit("test-protection:"), "id"), "test-protection", F.when(F.col("rises"), "decreased").otherwise("changed"), F.when(F.col("rises"), 88).otherwise(45))
    both = base.select("id", F.col("coupling").alias("before")).join(head.select("id", F.col("coupling").alias("after")), "id").where("before <> after")
    up = F.col("after") > F.col("before")
    coupling = change(both, F.concat(F.lit("coupling:"), "id"), "coupling", F.when(up, "increased").otherwise("decreased"), F.when(up, 68).otherwise(30))
    fresh = change(head_cycles.join(base_cycles, "key", "left_anti"), F.concat(F.lit("cycle:"), "key", F.lit(":introduced")), "cycle", F.lit("introduced"), F.lit(100))
    gone = change(base_cycles.join(head_cycles, "key", "left_anti"), F.concat(F.lit("cycle:"), "key", F.lit(":removed")), "cycle", F.lit("removed"), F.lit(40))
    out = None
    for place, part in enumerate((dependency, owner, complex_, test, coupling, fresh, gone)):
        part = part.withColumn("place", F.lit(place))
        out = part if out is None else out.union(part)
    last = out.groupBy("id").agg(F.max_by(F.struct("kind", "direction", "score"), F.struct("place", "score", "direction")).alias("x"))
    return last.select("id", "x.kind", "x.direction", "x.score").orderBy(F.desc("score"), "id")
