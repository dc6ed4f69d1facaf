"""What is laid over a graph for reading: evidence, findings, statuses, decorations, ports and crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Precedence of statuses; families of edge ports and their lanes.
STATUSES = ["added", "removed", "modified"]
LANES = {"control": 0, "data": 1, "async": 2, "ownership": 3}


def edge_evidence(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(edge, evidence, strength): what proves each edge.

    Edges (id, refs): a list of references, empty or not, counts alone, as far
    as its records exist; without a list the records about the edge count; an
    edge with neither list nor record gets an inferred one. evidence: id, edge,
    strength.
    """
    listed = edges.where("refs is not null").select(F.col("id").alias("edge"), F.explode("refs").alias("evidence")).distinct()
    listed = listed.join(evidence.select(F.col("id").alias("evidence"), "strength"), "evidence").select("edge", "evidence", "strength")
    open_ = edges.where("refs is null").select(F.col("id").alias("edge"))
    told = open_.join(evidence.select("edge", F.col("id").alias("evidence"), "strength"), "edge", "left")
    own = F.coalesce("evidence", F.concat(F.lit("legacy:"), "edge"))
    return listed.union(told.select("edge", own.alias("evidence"), F.coalesce("strength", F.lit("inferred")).alias("strength")))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, adjacent): edges at each node; a loop is adjacent once."""
    ends = edges.select("id", F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("target").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("x"))
    sums = ends.groupBy(F.col("x.node").alias("id")).agg(F.sum("x.into").alias("fan_in"), F.sum("x.out").alias("fan_out"), F.count_distinct(ends["id"]).alias("adjacent"))
    return nodes.select("id").join(sums, "id", "left").na.fill(0)


def finding_nodes(violations: DataFrame) -> DataFrame:
    """(violation, node): the nodes of a violation's path, else its primary node."""
    nodes = F.when(F.size(F.coalesce("path", F.array().cast("array<string>"))) > 0, F.col("path")).otherwise(F.array("primary_node"))
    return violations.select(F.col("id").alias("violation"), F.explode(nodes).alias("node"))


def violations_with_rules(violations: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations with severity and title of their rule; medium severity where the rule is unknown."""
    told = rules.select(F.col("id").alias("rule_id"), F.col("severity").alias("of_rule"), F.col("title").alias("rule_title"))
    return violations.join(told, "rule_id", "left").withColumn("severity", F.coalesce("of_rule", F.lit("medium"))).drop("of_rule")


def mode_filter(nodes: DataFrame, mode: str, found: DataFrame) -> DataFrame:
    """Contracts in contract mode, nodes of findings in lint mode, else all."""
    if mode == "contracts":
        return nodes.where("kind = 'contract'")
    return nodes.join(found.select(F.col("node").alias("id")).distinct(), "id", "left_semi") if mode == "lint" else nodes


def decorate(nodes: DataFrame, coverage: DataFrame, complexity: DataFrame, telemetry: DataFrame, contracts: DataFrame, hops: DataFrame) -> DataFrame:
    """Nodes with what each mode shows of them; each table has id and its one value column, once per id."""
    out = nodes
    for table in (coverage, complexity, telemetry, contracts, hops):
        out = out.join(table, "id", "left")
    return out


def status_of(members: DataFrame, statuses: DataFrame) -> DataFrame:
    """(rep, status): added before removed before modified, of (rep, id) and (id, status)."""
    order = F.array(*map(F.lit, STATUSES))
    least = members.join(statuses, "id").groupBy("rep").agg(F.min(F.array_position(order, F.col("status"))).alias("k"))
    return least.select("rep", F.element_at(order, F.col("k").cast("int")).alias("status"))


def upgrade_legacy(rows: DataFrame) -> DataFrame:
    """Deltas (id, status, before, after, reason) of rows that carry their change as ``pr``."""
    gone = F.col("pr") == "removed"
    return rows.where("pr is not null").select("id", F.col("pr").alias("status"), gone.alias("before"), (~gone).alias("after"), F.lit("legacy-change").alias("reason"))


def node_fingerprint(kind: Column, label: Column, pkg: Column, owners: Column, tags: Column, meta: Column) -> Column:
    """SHA-256 of a node's content, whatever the order of owners and tags; empty lists are none."""
    tidy = lambda a: F.when(F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0, F.array_sort(a))
    return F.sha2(F.to_json(F.struct(kind.alias("kind"), label.alias("label"), pkg.alias("pkg"), tidy(owners).alias("owners"), tidy(tags).alias("tags"), meta.alias("meta"))).cast("binary"), 256)


def snapshot_fingerprint(parts: DataFrame) -> str:
    """SHA-256 over the sorted fingerprints (column ``fp``) of a snapshot's parts, by way of 256 partial digests."""
    pieces = parts.groupBy(F.substring("fp", 1, 2).alias("head")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("fp")), "\n").cast("binary"), 256).alias("fp"))
    whole = pieces.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("head", "fp"))), lambda x: x["fp"]), "\n").cast("binary"), 256)).collect()
    return whole[0][0]


def changes_only(nodes: DataFrame, node_delta: DataFrame, edge_delta: DataFrame) -> DataFrame:
    """(id): changed nodes and the ends of changed edges, as far as they are known on a side."""
    ends = edge_delta.select(F.split("id", r"\|").alias("e")).select(F.explode(F.array(F.col("e")[0], F.col("e")[2])).alias("id"))
    return node_delta.select("id").union(ends.join(nodes.select("id"), "id", "left_semi")).distinct()


def review_graph(policy: str, nodes: DataFrame, edges: DataFrame, node_delta: DataFrame, edge_delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of the nodes and edges that a review shows: its changes only, or (``impact``, ``blast-radius``) all of its graph."""
    if policy != "changes-only":
        return nodes.select("id"), edges.select("id")
    return changes_only(nodes, node_delta, edge_delta), edge_delta.select("id")


def side(rows: DataFrame, delta: DataFrame, which: str) -> DataFrame:
    """Ids of the base or head side from the rows of either and a delta (id, status)."""
    absent, restored = ("added", "removed") if which == "base" else ("removed", "added")
    kept = rows.select("id").join(delta.where(F.col("status") == absent), "id", "left_anti")
    return kept.union(delta.where(F.col("status") == restored).select("id")).distinct()


def evidence_bundle(refs: DataFrame, edges: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """(what, id) of the edges, evidence and changes that factor references (kind, ref) lead to."""
    chosen = edges.join(refs.where("kind = 'edge'").select(F.col("ref").alias("id")), "id", "left_semi")
    proofs = evidence.join(chosen.select(F.col("id").alias("edge")), "edge", "left_semi")
    changes = events.join(refs.where("kind = 'git-change'").select(F.col("ref").alias("id")), "id", "left_semi")
    one = lambda rows, what: rows.select(F.lit(what).alias("what"), "id")
    return one(chosen, "edge").union(one(proofs, "evidence")).union(one(changes, "change"))


def in_scope(edges: DataFrame, focal: str, most: int = 30) -> DataFrame:
    """The first edges at a node, by id."""
    return edges.where((F.col("source") == focal) | (F.col("target") == focal)).orderBy("id").limit(most)


def port_family(kind: Column, boundary: Column) -> Column:
    none = F.coalesce(boundary, F.lit(""))
    return F.when((none == "async") | kind.isin("publishes", "consumes"), "async").when((none == "persistence") | kind.isin("reads", "writes", "transforms"), "data").when(kind.isin("owns", "implements", "tests"), "ownership").otherwise("control")


def edge_ports(edges: DataFrame) -> DataFrame:
    """(id, family, source_port, target_port, lane)"""
    rows = edges.select("id", port_family(F.col("kind"), F.col("boundary")).alias("family"))
    lane = F.coalesce(*[F.when(F.col("family") == k, v) for k, v in LANES.items()])
    return rows.select("id", "family", F.concat("family", F.lit("-out")).alias("source_port"), F.concat("family", F.lit("-in")).alias("target_port"), lane.alias("lane"))


def crossings(segments: DataFrame, tile: float) -> DataFrame:
    """(a, b): pairs of segments that cross, from (id, source, target, ax, ay, bx, by).

    Segments meet in the strips of width ``tile`` that they share; a pair counts
    in the first of these. Segments with an end node in common never cross.
    """
    strip = lambda x: F.floor(x / tile).cast("long")
    rows = segments.withColumns({"lo": strip(F.least("ax", "bx")), "hi": strip(F.greatest("ax", "bx"))})
    laid = rows.withColumn("strip", F.explode(F.sequence("lo", "hi")))
    p, q = laid.alias("p"), laid.alias("q")
    c = F.col
    met = p.join(q, "strip").where((c("p.id") < c("q.id")) & (c("strip") == F.greatest(c("p.lo"), c("q.lo"))))
    apart = (c("p.source") != c("q.source")) & (c("p.source") != c("q.target")) & (c("p.target") != c("q.source")) & (c("p.target") != c("q.target"))

    def turn(s: str, t: str, end: str) -> Column:
        """On which side of segment ``s`` an end of segment ``t`` lies."""
        return (c(f"{s}.by") - c(f"{s}.ay")) * (c(f"{t}.{end}x") - c(f"{s}.bx")) - (c(f"{s}.bx") - c(f"{s}.ax")) * (c(f"{t}.{end}y") - c(f"{s}.by"))

    hits = met.where(apart & (turn("p", "q", "a") * turn("p", "q", "b") < 0) & (turn("q", "p", "a") * turn("q", "p", "b") < 0))
    return hits.select(c("p.id").alias("a"), c("q.id").alias("b")).distinct()


def routing_decision(stage: int, baseline: int, prototype: int, proxies: list[float], milliseconds: float) -> str:
    """Whether another router is worth a trial: only for a material and cheap improvement at the last stage."""
    gain = (baseline - prototype) / baseline if baseline else 0.0
    worth = stage == 5 and baseline >= 4 and gain >= 0.25 and min(proxies) >= 0.9 and milliseconds <= 50
    return "evaluate-router" if worth else "retain-layout"
