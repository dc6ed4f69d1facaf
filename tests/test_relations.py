"""What the derived graph exchanges: lines are joined once, edges are told by their ends."""

from __future__ import annotations

from collections import Counter

from graphloom.operators import attention, facts, projection, ranking
from graphloom.plans import catalog, samples
from graphloom.plans.derived import Derived
from graphloom.registry import ProjectionRequest

SF = "/root/testdata/sf0.001"


def _joins(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_edges_read_the_joined_lines_once(spark):
    g = Derived(spark, SF)
    assert _joins(g.edges) == 0 and _joins(g.calls) == 2


def test_sides_are_compared_without_a_join(spark):
    edge = catalog._deltas(Derived(spark, SF))[1]
    assert _joins(edge) == 0


def test_counts_by_ends_equal_counts_of_rows(spark):
    units = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q")], "node string, unit string")
    node = spark.createDataFrame([("a", "modified"), ("c", "added"), ("z", "removed")], "id string, status string")
    edge = spark.createDataFrame([("a", "b", "added"), ("a", "c", "removed"), ("b", "t", "modified"), ("z", "t", "added"), ("c", "a", "added")], "source string, target string, status string")
    rows = [(n, s, None) for n, s in node.collect()] + [(n, r.status, f"{r.source}|{r.target}") for r in edge.collect() for n in (r.source, r.target)]
    touched = spark.createDataFrame(rows, "node string, status string, edge string").join(units, "node")
    got, want = (Counter(map(tuple, f.select("id", "nodes", "edges", "focal", "statuses").collect())) for f in (attention.touch_counts_by_ends(node, edge, units), attention.touch_counts(touched)))
    assert got == want and len(got) == 2


def test_pairs_of_units_tell_what_their_edges_tell(spark):
    units = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q"), ("d", "r")], "node string, unit string")
    packages = spark.createDataFrame([("p", "x", None), ("q", "y", None), ("r", None, None)], "id string, owner string, owners array<string>")
    edges = spark.createDataFrame([(f"{s}|calls|{t}", s, "calls", t) for s, t in ("ac", "bc", "ab", "ca", "cd")], "id string, source string, kind string, target string")
    got, want = (Counter(map(tuple, facts.cross_team(f(edges, units), packages).collect())) for f in (facts.unit_pairs, facts.unit_edges))
    assert got == want


def test_frontiers_exchange_their_candidates_once(spark):
    rows = spark.createDataFrame([("r", n, "calls", "function", 1.0, n, None, None, None, True, ["e"]) for n in "abcd"], "root string, node string, edge_kind string, node_kind string, score double, pkg string, service string, owner string, load double, within_depth boolean, evidence_ids array<string>")
    found = ranking.grouped_frontiers(rows, ["package"], 3)
    assert {(r.value, r.members, r.evidence) for r in found.collect()} == {("a", 1, 1), ("b", 1, 1), ("remainder", 2, 1)}
    assert _joins(found) == 1  # of counts with counts; before, candidates met their groups in three more


def test_a_view_scores_only_steps_at_nodes_it_asks_for(spark, monkeypatch):
    nodes = spark.createDataFrame([(n, "function", n, None, None, None) for n in "abcde"], "id string, kind string, label string, pkg string, service string, owner string")
    edges = spark.createDataFrame([(f"{s}|calls|{t}", s, "calls", t, True) for s, t in ("ab", "bc", "de")], "id string, source string, kind string, target string, sync boolean")
    asked, plain = [], projection.steps
    monkeypatch.setattr(projection, "steps", lambda *a, **k: asked.append(a[5]) or plain(*a, **k))
    found = projection.project(nodes, edges, ProjectionRequest(roots=("a",), projection="impact")).collect()
    assert {r.id for r in found if r.kind == "node"} >= {"a", "b"} and asked and not {"d", "e"} & {n for some in asked for n in some}


def test_rules_are_given_the_edges_they_read(spark, monkeypatch):
    given = []
    monkeypatch.setattr(samples.repository, "violations", lambda nodes, edges, owners: given.append(edges) or nodes)
    samples.rule_violations(Derived(spark, SF))
    assert "id" not in given[0].columns and {r.kind for r in given[0].select("kind").distinct().collect()} <= {"calls", "tests", "depends_on"}
