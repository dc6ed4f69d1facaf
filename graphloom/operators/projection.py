"""Bounded views: a budgeted walk around roots.

Spark filters the edges and scores every candidate step; the choice itself depends
on its own order (upstream before downstream, nodes first in first out, categories
by name), so it is made on the driver, which asks for the steps of the nodes that
the view shows, those in the queue at once: a budget of nodes, never a neighbourhood.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from ..registry import PROJECTIONS, TRANSPARENT, ProjectionRequest
from . import paths, ranking

STEP = ["at", "to", "edge", "kind", "upstream", "cost", "category", "score", "rank", "service", "pkg", "owner"]
OUT = "kind string, id string, parent string, direction string, depth long, via string, hidden long, score double"


def steps(nodes: DataFrame, edges: DataFrame, request: ProjectionRequest, evidence: DataFrame | None = None, telemetry: DataFrame | None = None, at: list[str] | None = None, degree: DataFrame | None = None) -> DataFrame:
    """Scored steps in both directions over eligible edges, with ``at`` only those at these nodes; see STEP.

    nodes: id, kind, label, pkg, service, owner and, if there, pr. Consumption is
    walked against its direction. Containment that touches a service or package
    is free. ``degree``: to, degree, if it is known.
    """
    kinds = [*PROJECTIONS[request.projection], *TRANSPARENT]
    kept = edges.where(F.col("kind").isin(kinds))
    if at is not None:
        kept = kept.where(F.col("source").isin(at) | F.col("target").isin(at))
    if evidence is not None:
        kept = kept.join(paths.eligible_evidence(evidence, request.evidence_level, request.include_stale, "2100-01-01").select(F.col("edge").alias("id")).distinct(), "id", "left_semi")
    turned = F.col("kind") == "consumes"
    seen = kept.select("id", "kind", "sync", F.when(turned, F.col("target")).otherwise(F.col("source")).alias("s"), F.when(turned, F.col("source")).otherwise(F.col("target")).alias("t"), *([F.col("pr").alias("edge_pr")] if "pr" in edges.columns else [F.lit(None).cast("string").alias("edge_pr")]))
    both = seen.select(F.col("id").alias("edge"), F.col("kind").alias("edge_kind"), "sync", "edge_pr", F.explode(F.array(F.struct(F.col("s").alias("at"), F.col("t").alias("to"), F.lit(False).alias("upstream")), F.struct(F.col("t").alias("at"), F.col("s").alias("to"), F.lit(True).alias("upstream")))).alias("x")).select("edge", "edge_kind", "sync", "edge_pr", "x.*")
    if at is not None:
        both = materialize(both.where(F.col("at").isin(at)), "near")  # its size is known to the joins that follow
    pr = F.col("pr") if "pr" in nodes.columns else F.lit(None).cast("string")
    ends = nodes.select(F.col("id").alias("to"), F.col("kind").alias("node_kind"), "label", "service", "pkg", F.col("owner").alias("own_to"), pr.alias("node_pr"))
    here = nodes.select(F.col("id").alias("at"), F.col("kind").alias("at_kind"), F.col("owner").alias("own_from"))
    degree = degrees(edges) if degree is None else degree
    rows = both.where("at <> to").join(ends, "to").join(here, "at").join(degree, "to", "left")
    null = F.lit(None).cast("double")
    if telemetry is not None:
        rows = rows.join(telemetry.select(F.col("node_id").alias("to"), "rpm", "qps"), "to", "left").withColumn("runtime", F.when(F.col("rpm").isNotNull() | F.col("qps").isNotNull(), ranking.runtime_signal(F.col("rpm"), F.col("qps"), null, null, null)))
    else:
        rows = rows.withColumn("runtime", null)
    free = F.col("edge_kind").isin(TRANSPARENT) & (F.col("node_kind").isin("service", "package") | F.col("at_kind").isin("service", "package"))
    scored = ranking.with_score(rows.withColumns({"depth": F.lit(1), "finding": F.lit(False), "node": F.col("to")}))
    relation = F.array_position(F.array(*map(F.lit, ranking.RELATIONS)), F.col("edge_kind"))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in ranking.KINDS.items() for x in kv]), F.col("node_kind"))
    rank = F.format_string("%02d%02d%s\u0001%s", relation.cast("int"), F.coalesce(kind, F.lit(99)), F.col("label"), F.col("to"))
    return scored.select("at", "to", "edge", F.col("edge_kind").alias("kind"), "upstream", F.when(free, 0).otherwise(1).alias("cost"), ranking.category(F.col("edge_kind"), F.col("upstream")).alias("category"), "score", rank.alias("rank"), "service", "pkg", F.col("own_to").alias("owner"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("to")).groupBy("to").agg(F.count("*").alias("degree"))


def _discount(depth: int) -> float:
    """What the directness signal loses at a depth, against depth 1."""
    return 0.0 if depth <= 1 else ranking.WEIGHTS["direct"] * (1 - 1 / max(2, depth))


class Walk:
    """The choice for one request; ``fetch`` gives the steps of some nodes."""

    def __init__(self, fetch: Callable[[list[str]], pd.DataFrame], request: ProjectionRequest, roots: list[str]):
        self.request, self.roots, self.fetch = request, roots, fetch
        self.near: dict[tuple[str, bool], list] = defaultdict(list)
        self.held: set[str] = set()
        self.seen: dict[str, tuple] = {r: (None, None, 0, None) for r in roots}
        self.edges: dict[str, str] = {}
        self.frontiers: dict[str, tuple] = {}

    def hold(self, nodes: list[str]) -> None:
        """Have the steps of these nodes."""
        fresh = sorted(set(nodes) - self.held)
        if fresh:
            self.held.update(fresh)
            for row in self.fetch(fresh).sort_values(["kind", "edge"]).itertuples(index=False):
                self.near[row.at, row.upstream].append(row)

    def go(self, upstream: bool, depth: int | None, room: int) -> None:
        if depth == 0:
            return
        limit = math.inf if depth is None else depth
        best = dict.fromkeys(self.roots, 0)
        queue = [(r, 0) for r in self.roots]
        for place, (node, so_far) in enumerate(queue):
            if node not in self.held:
                self.hold([n for n, _ in queue[place:]])
            groups: dict[str, dict[str, tuple]] = defaultdict(dict)
            for row in self.near[node, upstream]:
                after = so_far + row.cost
                if best.get(row.to, math.inf) > after:
                    groups[row.category].setdefault(row.to, (row.score - _discount(after), after, row))
            for name in sorted(groups):
                ranked = sorted(groups[name].values(), key=lambda c: (-c[0], c[1], c[2].rank))
                for score, after, row in self.choose(node, upstream, name, ranked, limit, room):
                    self.seen.setdefault(row.to, (upstream, row.edge, after, score))
                    self.edges[row.edge] = node
                    if after < best.get(row.to, math.inf):
                        best[row.to] = after
                        queue.append((row.to, after))

    def fit(self, candidates: list[tuple], room: int) -> list[tuple]:
        """Candidates already visible, and as many new ones as there is room for."""
        out = []
        for c in candidates:
            new = c[2].to not in self.seen
            if not new or room > 0:
                out.append(c)
                room -= new
        return out

    def choose(self, node: str, upstream: bool, name: str, ranked: list[tuple], limit: float, room: int) -> list[tuple]:
        asked, direction = self.request.expansions, "upstream" if upstream else "downstream"
        id_ = f"{direction}:{quote(node, safe=SAFE)}:{name}"
        pages = max(0, asked.get(id_, 0))
        usable = [c for c in ranked if c[1] <= limit] + [c for c in ranked if c[1] > limit and pages]
        left = max(0, min(room, self.request.budget) - len(self.seen))
        member = any(c[2].service or c[2].pkg or c[2].owner for c in ranked)
        if len(ranked) > self.request.branch and member:
            picked = self.grouped(node, direction, ranked, {c[2].to for c in usable})
            deep = any(v > 0 for v in asked.values())
            return self.fit(sorted((c for c in picked if c[1] <= limit or deep), key=lambda c: (-c[0], c[1], c[2].rank)), left)
        chosen = self.fit(usable, min(self.request.branch + pages * self.request.page, left))
        hidden = [c for c in ranked if c not in chosen]
        if hidden:
            self.frontiers[id_] = (node, direction, len(hidden), self.weight(hidden))
        return chosen

    @staticmethod
    def weight(members: list[tuple]) -> float:
        return max(0.0, *(c[0] for c in members)) + math.log1p(len(members)) * 0.25

    def groups(self, members: list[tuple], prefix: str, dimensions: tuple[str, ...]) -> list[tuple[str, str, list[tuple]]]:
        """(id, dimension, members) by the first dimension that any has; the last ones folded into a remainder."""
        value = {"service": lambda c: c[2].service, "package": lambda c: c[2].pkg, "relation": lambda c: c[2].kind}
        dimension = next((d for d in dimensions if any(value[d](c) for c in members)), "relation")
        buckets: dict[str, list] = defaultdict(list)
        for c in members:
            buckets[value[dimension](c) or "ungrouped"].append(c)
        ordered = sorted(buckets.items(), key=lambda kv: (-self.weight(kv[1]), kv[0]))
        if len(ordered) > 6:
            rest = {c[2].to for _, m in ordered[5:] for c in m}
            ordered = [*ordered[:5], ("remainder", [c for c in members if c[2].to in rest])]
            return [(f"{prefix}{'remainder' if k == 5 else dimension}:{quote(v, safe=SAFE)}", dimension, m) for k, (v, m) in enumerate(ordered)]
        return [(f"{prefix}{dimension}:{quote(v, safe=SAFE)}", dimension, m) for v, m in ordered]

    def grouped(self, node: str, direction: str, ranked: list[tuple], usable: set[str]) -> list[tuple]:
        prefix = f"frontier:{direction}:{quote(node, safe=SAFE)}:"
        picked: list[tuple] = []

        def settle(id_: str, members: list[tuple]) -> bool:
            if self.request.expansions.get(id_):
                return True
            picked.extend(c for c in members if c[2].to in self.seen and c[2].to in usable)
            self.frontiers[id_] = (node, direction, len(members), self.weight(members))
            return False

        for id_, dimension, members in self.groups(ranked, prefix, ("service", "package", "relation")):
            if not settle(id_, members):
                continue
            if dimension == "service" and len(members) > self.request.branch:
                for child, _, inner in self.groups(members, f"{prefix}{quote(id_, safe=SAFE)}:", ("package", "relation")):
                    if settle(child, inner):
                        picked.extend(inner)
            else:
                picked.extend(members)
        return picked

    def rows(self) -> list[tuple]:
        found = [("node", n, None, None if up is None else "upstream" if up else "downstream", depth, via, 0, score) for n, (up, via, depth, score) in self.seen.items()]
        room = max(0, max(self.request.budget, self.request.hard_budget) - len(self.seen))
        kept = sorted(self.frontiers.items(), key=lambda kv: (-kv[1][3], kv[0]))
        found += [("frontier", id_, node, direction, None, None, hidden, weight) for id_, (node, direction, hidden, weight) in kept[:room]]
        return found + [("warning", "hard-budget", None, None, None, None, len(kept) - room, None)] * (len(kept) > room) + [("edge", e, None, None, None, None, 0, None) for e in sorted(self.edges)]


SAFE = "-_.!~*'()"


def project(nodes: DataFrame, edges: DataFrame, request: ProjectionRequest, evidence: DataFrame | None = None, telemetry: DataFrame | None = None) -> DataFrame:
    """(kind, id, parent, direction, depth, via, hidden, score): visible nodes and edges, frontiers and warnings.

    Without a known root the view is a bounded overview of services and packages.
    """
    spark = nodes.sparkSession
    asked = list(dict.fromkeys([*request.roots, *request.required_nodes, *request.pins]))
    known = {r["id"] for r in nodes.where(F.col("id").isin(asked)).select("id").collect()}
    roots = [r for r in asked if r in known][: request.budget]
    warnings = [(c,) for c, hit in (("missing-root", set(request.roots) - known), ("missing-pin", set(request.pins) - known), ("broken-path", set(request.required_nodes) - known), ("root-budget", len([r for r in asked if r in known]) > len(roots))) if hit]
    warned = spark.createDataFrame(warnings, "id string").select(F.lit("warning").alias("kind"), "id", *[F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in OUT.split(", ")[2:])])
    if not roots:
        return overview(nodes, request.budget).select(F.lit("node").alias("kind"), "id", *[F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in OUT.split(", ")[2:])]).union(warned)
    nodes, degree = materialize(nodes, "nodes"), materialize(degrees(edges), "degrees")
    # steps are scored at the nodes that are asked for, never at all
    walk = Walk(lambda some: steps(nodes, edges, request, evidence, telemetry, some, degree).toPandas(), request, roots)
    walk.go(True, request.upstream, min(request.budget, len(roots) + max(4, math.floor((request.budget - len(roots)) * 0.35))))
    walk.go(False, request.downstream, request.budget)
    walk.hold(roots)
    between = {row.edge for (at, _), rows in walk.near.items() if at in roots for row in rows if row.to in roots}
    wanted = edges.where(F.col("id").isin(list(request.required_edges)))
    asked_for = steps(nodes, wanted, request, evidence, telemetry, degree=degree).select("edge").distinct().collect() if request.required_edges else []
    walk.edges |= dict.fromkeys(between | {r["edge"] for r in asked_for}, "")
    return spark.createDataFrame(walk.rows(), OUT).union(warned)


def overview(nodes: DataFrame, budget: int = 30) -> DataFrame:
    """Services and packages, else resources, else anything: the first by kind, label and id."""
    rank = F.when(F.col("kind").isin("service", "package"), 0).when(F.col("kind").isin("endpoint", "contract", "topic", "table", "external"), 1).otherwise(2)
    ranked = nodes.withColumn("__class", rank)
    least = ranked.agg(F.min("__class")).collect()[0][0]
    return ranked.where(F.col("__class") == F.lit(least)).orderBy("kind", "label", "id").limit(budget).drop("__class")


def review_roots(explicit: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): explicit roots, changed nodes and the ends of changed edges, by their ``pr``."""
    ends = edges.where("pr is not null").select(F.explode(F.array("source", "target")).alias("id"))
    return explicit.select("id").union(nodes.where("pr is not null").select("id")).union(ends).distinct()
