from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom import investigation
from graphloom.functions import ids, predicates
from graphloom.operators import attention, facts, graph, overlays, paths, projection, ranking, review, structure, temporal
from graphloom.registry import PROJECTIONS, ProjectionRequest

EDGE = "id string, source string, target string, kind string, label string, boundary string, sync boolean, observations long"
NODE = "id string, kind string, label string, pkg string, service string, owner string"


def edges_of(spark, rows):
    """(source, kind, target) as edges."""
    return spark.createDataFrame([(f"{s}|{k}|{t}", s, t, k, k, None, True, 1) for s, k, t in rows], EDGE)


def nodes_of(spark, rows):
    """id, or (id, kind, pkg, service, owner), as nodes."""
    full = [(r, "function", None, None, None) if isinstance(r, str) else (*r, *[None] * (5 - len(r))) for r in rows]
    return spark.createDataFrame([(i, k, i, p, s, o) for i, k, p, s, o in full], NODE)


def test_stable_ids(spark):
    import hashlib

    row = spark.range(1).select(ids.stable_id("package", F.lit("a/b")).alias("a"), ids.encode_component(F.lit("a b~c/!'()*:")).alias("b"), ids.map_fingerprint(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("c"), ids.author_key(F.lit(" Dev@Example.com ")).alias("d"), ids.repository_id(F.lit("/x")).alias("e")).first()
    assert row.a == "package:" + hashlib.sha1(b"package\0a/b").hexdigest()[:16] and row.b == "a%20b~c%2F!'()*%3A"
    assert row.c == hashlib.sha256(b"a=1\nb=2\n").hexdigest() and row.d == hashlib.sha256(b"dev@example.com").hexdigest()[:16] and row.e == hashlib.sha256(b"/x").hexdigest()[:16]


def test_predicates(spark):
    rows = spark.createDataFrame([("a/b.go:12", "Api/Schema/x", "LICENSE"), ("x", "vendor/y.go", "a.pb.go")], "loc string, p string, q string")
    got = rows.select(predicates.source_file(F.col("loc")), predicates.source_line(F.col("loc")), predicates.subsystem(F.col("p")), predicates.architecture_bearing(F.col("p")), predicates.is_generated(F.col("p")), predicates.is_plain(F.col("q")), predicates.is_generated(F.col("q"))).collect()
    assert [tuple(r) for r in got] == [("a/b.go", 12, "Api", True, False, True, False), ("x", None, "vendor", False, True, False, True)]
    shown = spark.range(1).select(*[predicates.display_value(F.lit(v), u) for v, u in ((0.456, "normalized"), (3.0, "packages"), (2.34, "changes"))]).first()
    assert tuple(shown) == ("0.46", "3 packages", "2.3 changes")
    symbols = spark.createDataFrame([("pub", None, True), ("priv", None, False), ("pkg", "dir/pub", None)], "label string, file string, exported boolean")
    assert {r.label for r in symbols.where(predicates.symbol_matches("P")).collect()} == {"pub", "pkg"}
    assert symbols.where(predicates.symbol_matches("priv", True)).count() == 1
    assert spark.range(1).select(predicates.relationship_override(["a", "b"], ["c"], ["a"])).first()[0] == ["b", "c"]


def test_edges_collapse(spark):
    rows = [("a", "calls", "b", "first", None, 1), ("a", "calls", "b", "second", None, 2), ("a", "calls", "a", "loop", None, 3), ("a", "publishes", "t", "p", "async", 4), ("a", "reads", "d", "q", "persistence", 5), ("", "calls", "b", "", None, 6)]
    got = {r.id: (r.label, r.sync, r.observations) for r in facts.collapse_edges(spark.createDataFrame(rows, "source string, kind string, target string, label string, boundary string, ord long")).collect()}
    assert got == {"a|calls|b": ("first", True, 2), "a|publishes|t": ("p", False, 1), "a|reads|d": ("q", True, 1)}


def test_endpoints_follow_their_handlers(spark):
    nodes = nodes_of(spark, [("p", "package"), ("q", "package"), ("f", "function", "p"), ("e", "endpoint"), ("g", "function", "unknown")])
    edges = edges_of(spark, [("e", "calls", "f")]).withColumn("label", F.lit("handler"))
    assert {(r.node, r.unit) for r in facts.endpoint_units(nodes, edges).collect()} == {("p", "p"), ("q", "q"), ("f", "p"), ("e", "p")}


def test_owners_differ_only_when_known(spark):
    rows = spark.createDataFrame([(["a"], ["b"]), (["a", "b"], ["b"]), (None, ["b"]), ([], ["b"])], "x array<string>, y array<string>")
    assert [r[0] for r in rows.select(facts.owners_differ(facts.owner_list(F.lit(""), F.col("x")), F.col("y"))).collect()] == [True, False, False, False]


def test_longest_prefix(spark):
    folders = spark.createDataFrame([("", "root"), ("web", "web"), ("web/src", "src")], "folder string, unit string")
    files = spark.createDataFrame([("schema.sql",), ("web/src/App.tsx",), ("web/x",), ("other/x",), ("webby/x",)], "path string")
    own = spark.createDataFrame([("web/x", "mine")], "path string, unit string")
    assert {r.path: r.unit for r in facts.longest_prefix_unit(files, folders, own).collect()} == {"schema.sql": "root", "web/src/App.tsx": "src", "web/x": "mine"}


# Graph kernels against plain versions


def plain_components(nodes, pairs):
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for u, v in pairs:
            for x in nodes:
                if u in reach[x]:
                    reach[x].add(v)
    return {n: frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def plain_betweenness(nodes, pairs, sources, weights):
    out = defaultdict(list)
    for u, v in pairs:
        out[u].append(v)
    score = dict.fromkeys(nodes, 0.0)
    for s in sources:
        dist, sigma, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], [s]
        while queue:
            u = queue.pop(0)
            order.append(u)
            for v in out[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    queue.append(v)
                if dist[v] == dist[u] + 1:
                    sigma[v] += sigma[u] * weights[u, v]
        delta = defaultdict(float)
        for u in reversed(order):
            for v in out[u]:
                if dist[v] == dist[u] + 1:
                    delta[u] += sigma[u] * weights[u, v] / sigma[v] * (1 + delta[v])
            if u != s:
                score[u] += delta[u]
    top = max(score.values(), default=0)
    return {n: x / top if top else 0.0 for n, x in score.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_kernels_on_random_graphs(spark, monkeypatch, seed):
    r = random.Random(seed)
    nodes = [f"n{k:02d}" for k in range(12)]
    raw = [(r.choice(nodes), r.choice(nodes)) for _ in range(18)]
    raw = [(u, v) for u, v in raw if u != v]
    pairs = spark.createDataFrame(raw, "u string, v string")
    frame = spark.createDataFrame([(n,) for n in nodes], "id string")
    reach = graph.closure(pairs)
    found = {x.node: x.component for x in graph.components_of(reach).collect()}
    want = {n: min(c) for n, c in plain_components(nodes, raw).items() if len(c) > 1}
    assert found == want
    weights = defaultdict(int)
    for p in raw:
        weights[p] += 1
    for spaced, multiple, most in ((True, False, 64), (False, True, 5), (True, False, 4)):
        sources = nodes if most >= 12 else [nodes[i * 11 // (most - 1)] for i in range(most)] if spaced else nodes[:most]
        plain = plain_betweenness(nodes, sorted(set(raw)), sources, weights if multiple else defaultdict(lambda: 1))
        for local in (graph.LOCAL_EDGES, 0):
            monkeypatch.setattr(graph, "LOCAL_EDGES", local)
            got = {x.id: x.score for x in graph.betweenness(pairs, frame, most, spaced, multiple).collect()}
            assert all(math.isclose(got[n], plain[n], abs_tol=1e-9) for n in nodes)
        monkeypatch.undo()


def test_closure_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(100)], "u long, v long")
    assert graph.closure(pairs).count() == 100 * 101 // 2


def test_impact_follows_its_kinds_only(spark):
    nodes = nodes_of(spark, ["root", "caller", "test", "table", "reader", "far", "farther"])
    edges = edges_of(spark, [("caller", "calls", "root"), ("test", "tests", "caller"), ("root", "writes", "table"), ("reader", "reads", "table"), ("far", "depends_on", "test"), ("farther", "calls", "far"), ("ghost", "calls", "root")])
    root = spark.createDataFrame([("root",)], "id string")
    found = graph.impact(nodes, edges, root, 3)
    assert {r.node: r.hop for r in found.collect()} == {"root": 0, "caller": 1, "table": 1, "test": 2, "far": 3}
    assert graph.induced_edges(edges, found).count() == 4 and graph.impact(nodes, edges, root, 0).count() == 3


def test_structural_example(spark):
    nodes = nodes_of(spark, [("a", "service", None, None, "one"), ("b", "service", None, None, "one"), ("c", "service", None, None, "two"), ("d", "service", None, None, "two")])
    edges = edges_of(spark, [("a", "calls", "b"), ("a", "calls", "c"), ("b", "depends_on", "c"), ("c", "calls", "d"), ("d", "calls", "b")])
    got = {r.id: r for r in structure.structural_metrics(edges, nodes, 64).collect()}
    assert (got["a"].fan_out, got["b"].fan_in, got["c"].coupling, got["d"].depth) == (2, 2, 3, 2)
    assert {r.node for r in structure.structural_cycles(edges, nodes).collect()} == {"b", "c", "d"} and math.isclose(got["b"].boundary_density, 2 / 3)
    loop = edges_of(spark, [("a", "calls", "a")])
    assert structure.structural_cycles(loop, nodes).collect()[0].component == "a"
    ranked = structure.hotspots(structure.structural_metrics(edges, nodes, 64), spark.createDataFrame([("a", 10)], "id string, score int"), spark.createDataFrame([("a",)], "id string")).collect()
    assert ranked[0].id == "a"


def test_abstraction(spark):
    nodes = nodes_of(spark, [("sa", "service"), ("sb", "service"), ("pa", "package", None, "sa"), ("pb", "package", None, "sb"), ("a1", "function", "pa", "sa"), ("a2", "function", "pa", "sa"), ("b1", "function", "pb", "sb"), ("x", "function", "nowhere", "gone")])
    edges = edges_of(spark, [("a1", "calls", "b1"), ("a2", "calls", "b1"), ("a1", "calls", "a2")])
    folded = structure.fold(edges, structure.representatives(nodes, "service")).collect()
    assert [(r.source, r.target, r.members, r.label) for r in folded] == [("sa", "sb", 2, "contains 2 underlying relationships")]
    assert {r.rep for r in structure.representatives(nodes, "component").where("node = 'x'").collect()} == {"x"}
    mixed = structure.fold(edges, structure.mixed_representatives(nodes, "pa", "package", "symbol")).collect()
    assert {(r.source, r.target) for r in mixed} == {("a1", "pb"), ("a2", "pb"), ("a1", "a2")}
    assert {r.id: r.members for r in structure.fold_nodes(structure.representatives(nodes, "package")).collect()}["pa"] == 3


def test_evolution_order(spark):
    delta = spark.createDataFrame([("a|calls|c", "added"), ("b|calls|c", "removed"), ("x|calls|y", "modified")], "id string, status string")
    reasons = spark.createDataFrame([("a", "ownership-changed", False), ("a", "complexity-changed", True), ("a", "test-protection-changed", True), ("a", "other", False)], "id string, reason string, rises boolean")
    side = lambda **c: spark.createDataFrame(list(c.items()), "id string, coupling int")
    key = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    found = structure.evolution(delta, reasons, side(a=1, b=2), side(a=3, b=1), key("p|q"), key("b|c")).collect()
    assert [(r.kind, r.direction, r.score) for r in found] == [("cycle", "introduced", 100), ("dependency", "introduced", 90), ("test-protection", "decreased", 88), ("ownership", "changed", 80), ("complexity", "increased", 72), ("coupling", "increased", 68), ("dependency", "removed", 65), ("cycle", "removed", 40), ("coupling", "decreased", 30)]


# Attention


def unit_row(**more):
    base = {f[5]: 0.0 for f in attention.FACTORS if f[5]} | {"id": "u", "known_in": True, "known_out": True, "observed": False, "history": False}
    return base | more


def test_dimension_coverage_and_null_scores(spark):
    rows = [unit_row(id="a", incoming=2.0), unit_row(id="b", known_in=False, observed=True, traffic=5.0)]
    long = attention.factors(spark.createDataFrame(rows))
    got = {(r.id, r.dimension): (r.score, round(r.coverage, 6)) for r in attention.dimensions(long).collect()}
    assert got["a", "impact"][1] == 0.8 and got["b", "impact"][1] == 0.8 and got["a", "velocity"] == (None, 0.0) and got["a", "complexity"] == (0, 1.0)
    assert got["a", "impact"][0] == 25
    empty = attention.dimensions(attention.factors(spark.createDataFrame([unit_row(history=True)]))).where("dimension = 'velocity'").first()
    assert empty.score == 0 and round(empty.coverage, 6) == 1


def test_priority_bonus_and_regions(spark):
    rows = [("a", 50, 60, 65), ("b", 50, 0, None), ("c", 0, 60, 70), ("d", 49, 59, 100), ("e", 100, 100, 100)]
    scores = spark.createDataFrame([(i, d, s) for i, *v in rows for d, s in zip(("impact", "complexity", "velocity"), v, strict=True)], "id string, dimension string, score int")
    got = {r.id: (r.priority, r.region) for r in attention.priorities(scores).collect()}
    assert got == {"a": (72, "investigate"), "b": (28, "protect"), "c": (40, "simplify"), "d": (63, "low-attention"), "e": (100, "investigate")}


def test_velocity_example(spark):
    rows = [("git:1", "2026-09-03 00:00:00", "dev", "u", "src/a.go", 100, False), ("git:1", "2026-09-03 00:00:00", "dev", "u", "db/schema.sql", 4, False), ("git:2", "2026-08-04 00:00:00", "eve", "u", "a.go", 5000, True), ("git:3", "2026-01-01 00:00:00", "old", "u", "a.go", 9, False), ("git:4", "2026-09-03 00:00:00", "x", "u", "README.md", 9, False)]
    frame = spark.createDataFrame(rows, "id string, occurred_at string, author string, unit string, path string, lines long, noise boolean").withColumn("occurred_at", F.to_timestamp("occurred_at"))
    got = attention.velocity(frame, "2026-09-03 00:00:00", 90).first()
    assert math.isclose(got.churn, 104 + 1000 * 0.5 * 0.2) and math.isclose(got.change_sets, 1.1) and got.topology == 1 and (got.weeks, got.authors) == (2, 2)


def test_percentiles_take_the_nearest_rank(spark):
    frame = spark.createDataFrame([("u", k) for k in range(1, 11)], "unit string, score int")
    assert attention.local_complexity(frame).first().local_complexity == 9


def test_findings_and_review_units(spark):
    long = attention.factors(spark.createDataFrame([unit_row(id="p", incoming=9.0, outgoing=4.0, in_cycle=1.0), unit_row(id="q", incoming=1.0)]))
    ranked = spark.createDataFrame([("p", 80, 70, None, 90, "investigate"), ("q", 50, 0, None, 44, "protect")], "id string, impact int, complexity int, velocity int, priority int, region string")
    found = attention.findings(ranked, long, spark.createDataFrame([("p", "Pay"), ("q", "Q")], "id string, label string")).collect()
    assert [(r.id, r.title) for r in found] == [("p", "Pay combines high impact and change complexity")] and found[0].explanation == "Direct dependents: 9 packages; Dependency cycle participation: 1 boolean"
    touched = spark.createDataFrame([("q", "added", "n2", None), ("q", "modified", "n1", "e1")], "unit string, status string, node string, edge string")
    units = attention.review_units(ranked, touched).collect()
    assert [(r.id, r.review_priority, r.focal, r.statuses) for r in units] == [("q", 51, "n1", "added,modified"), ("p", 90, None, "")]


# Reviews and contracts


def test_reviews(spark):
    schema = "id string, kind string, label string, pkg string, file string, exported boolean, cyclomatic int, loc int"
    base = spark.createDataFrame([("1", "fn", "a", "p", "f", True, 1, 1), ("3", "fn", "c", "p", "f", True, 1, 1)], schema)
    head = spark.createDataFrame([("1", "fn", "b", "q", "f", None, 1, 1), ("2", "fn", "n", "p", "f", True, 1, 1)], schema)
    node = review.diff(base, head, "id", schema.replace(" string", "").replace(" boolean", "").replace(" int", "").split(", ")[1:]).withColumn("reasons", review.node_reasons())
    assert {r.id: r.reasons for r in node.collect()} == {"1": "field-changed,metadata-changed,ownership-changed", "2": "entity-added", "3": "entity-removed"}
    old, new = edges_of(spark, [("1", "calls", "3"), ("1", "calls", "9")]), edges_of(spark, [("1", "calls", "2"), ("1", "calls", "9")]).withColumn("observations", F.lit(2).cast("long"))
    edge = review.diff(old, new, "id", ["label", "boundary", "sync", "observations"]).withColumn("reasons", review.edge_reasons())
    assert {r.id: r.reasons for r in edge.collect()} == {"1|calls|3": "dependency-removed", "1|calls|2": "dependency-added", "1|calls|9": "evidence-changed"}
    assert review.summary(node, edge).first().asDict() == {"added_nodes": 1, "removed_nodes": 1, "modified_nodes": 1, "added_edges": 1, "removed_edges": 1, "modified_edges": 1}
    changed = review.changed_nodes(node, edge)
    more = edges_of(spark, [("9", "calls", "10"), ("10", "calls", "11")])
    assert {r.id for r in review.visible_nodes(changed, old, more).collect()} == {"1", "2", "3", "9", "10"}
    told = review.with_reasons(node, spark.createDataFrame([("1", "runtime-changed"), ("2", "contract-changed"), ("8", "complexity-changed"), ("ghost", "x")], "id string, reason string"), spark.createDataFrame([("1",), ("2",), ("8",)], "id string"))
    assert {r.id: (r.status, r.reasons) for r in told.collect()}["8"] == ("modified", "complexity-changed") and told.count() == 4


def test_contract_compatibility(spark):
    side = lambda *rows: spark.createDataFrame(rows, "contract string, path string, value string")
    base = side(("a", "/x/type", "string:int"), ("a", "/x/description", "string:d"), ("b", "/y", "1"), ("c", "/z", "1"), ("d", "/q/title", "1"))
    head = side(("a", "/x/type", "string:int"), ("a", "/components/schemas/Order/required/0", "string:id"), ("b", "/y", "2"), ("n", "/z", "1"), ("d", "/q/title", "2"))
    fields = {(r.contract, r.path): (r.kind, r.compat) for r in review.contract_fields(base, head).collect()}
    assert fields == {("a", "/x/description"): ("removed", "safe"), ("a", "/components/schemas/Order/required/0"): ("added", "break"), ("b", "/y"): ("changed", "potential"), ("d", "/q/title"): ("changed", "safe")}
    assert {r.contract: (r.status, r.compatibility) for r in review.contract_changes(base, head).collect()} == {"a": ("modified", "break"), "b": ("modified", "potential"), "c": ("removed", "break"), "d": ("modified", "safe"), "n": ("added", "safe")}


# Timelines


def test_replay_and_retention(spark):
    base = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, body string")
    deltas = spark.createDataFrame([(1, "b", "modified", "B2"), (2, "a", "removed", None), (1, "c", "added", "C")], "seq int, id string, status string, body string")
    assert {(r.id, r.body) for r in temporal.replay(base, deltas).collect()} == {("b", "B2"), ("c", "C")}
    sizes = lambda *x: temporal.storage_profile(spark.createDataFrame([(v,) for v in x], "storage_bytes long")).first()
    assert tuple(sizes(100, 120)) == (2, 220, 110, "full-snapshots") and sizes(*[1] * 21).recommendation == "checkpoint-deltas" and tuple(sizes())[:3] == (0, 0, 0)
    reviews = spark.createDataFrame([("r1", "t", 5), ("r0", "t", 4), ("r2", "t", 3)], "review string, created_at string, head int")
    added = spark.createDataFrame([("r1", "e"), ("r0", "e"), ("r2", "e")], "review string, edge string")
    assert temporal.dependency_introduction(reviews, added, spark.createDataFrame([(5,), (4,)], "snapshot int")).first().review == "r0"


def test_store_keeps_whole_snapshots(spark, tmp_path):
    from graphloom.sources.store import Store

    store = Store(spark, str(tmp_path / "store"))
    assert store.snapshots().count() == 0 and store.recall("profile", {"snapshot": "1"}) is None
    store.register("r", "old")
    store.register("r", "new")
    assert [tuple(x) for x in store.repositories().collect()] == [("r", "new")]
    nodes = nodes_of(spark, ["a"])
    first, second, third = (store.save("r", k, "c", nodes=nodes, edges=edges_of(spark, [])) for k in ("index", "review", "index"))
    assert store.current("r") == third and store.load("nodes", "r", first).count() == 1 and store.snapshots().where("storage_bytes > 0").count() == 3
    store.save_review("r", "v", first, second, spark.createDataFrame([("node", "a", "added", "")], "what string, id string, status string, reasons string"))
    assert store.latest_review("r").first().review == "v" and store.delta("v").count() == 1
    fourth = store.save("r", "index", "d", nodes=nodes)
    assert store.compact(1) == [third] and {r.snapshot_id for r in store.snapshots().collect()} == {first, second, fourth}
    with pytest.raises(KeyError):
        store.load("nodes", "r", third)
    pair = store.save_pair("r", "w", ("a", "b"), {"nodes": nodes}, {"nodes": nodes}, spark.createDataFrame([("node", "a", "added", "")], "what string, id string, status string, reasons string"))
    snapshots, reviews = store.timeline("r")
    assert {r.snapshot_id for r in snapshots.where("kind = 'review'").collect()} >= set(pair) and [r.review for r in reviews.collect()] == ["v", "w"] and store.current("r") == fourth
    store.remember("profile", {"snapshot": "1", "window": "90"}, nodes)
    assert store.recall("profile", {"snapshot": "1", "window": "90"}).count() == 1 and store.recall("profile", {"snapshot": "1", "window": "90"}, 0) is None


def test_history_merges_and_streams(spark, tmp_path):
    from graphloom.streaming import history

    schema = "id string, occurred_at timestamp, unit string, author string, lines long"
    old = spark.createDataFrame([("1", "2024-01-01", "u", "a", 1), ("2", "2024-01-09", "u", "a", 1)], "id string, occurred_at string, unit string, author string, lines long").withColumn("occurred_at", F.to_timestamp("occurred_at"))
    new = old.where("id = '2'").withColumn("lines", F.lit(7).cast("long")).union(old.where("id = '2'").withColumn("id", F.lit("3")))
    got = temporal.merge_history(old, new, F.lit("2024-01-05").cast("timestamp")).collect()
    assert [(r.id, r.lines) for r in got] == [("2", 7), ("3", 1)]
    old.union(new).write.parquet(str(tmp_path / "in"))
    later = old.limit(1).withColumns({"id": F.lit("9"), "occurred_at": F.to_timestamp(F.lit("2024-03-01"))})
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(str(tmp_path / "in"))
    for name, stream, mode in (("once", history.new_events(source), "append"), ("weeks", history.weekly_activity(source), "append")):
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        if name == "weeks":
            later.write.mode("append").parquet(str(tmp_path / "in"))
            query.processAllAvailable()
        query.stop()
    assert sorted(r.id for r in spark.table("once").collect()) == ["1", "2", "3"]
    assert {str(r.week)[:10] for r in spark.table("weeks").collect()} == {"2024-01-01", "2024-01-08"}


# Paths


def path_case(spark, edges, src, dst, query="semantic-dependency", strength=None, most=3):
    frame = edges_of(spark, edges)
    pairs = spark.createDataFrame([(src, dst)], "src string, dst string")
    return [[n for n in r.nodes] for r in paths.paths(paths.steps(frame, paths.POLICIES[query]), pairs, most).orderBy("rank").collect()]


def test_paths(spark):
    assert path_case(spark, [("create", "publishes", "event"), ("payment", "consumes", "event")], "create", "payment") == [["create", "event", "payment"]]
    assert path_case(spark, [("orders", "owns", "create"), ("orders", "calls", "payment")], "create", "payment") == [["create", "orders", "payment"]]
    up_down = [("orders", "owns", "create"), ("orders", "owns", "sibling"), ("create", "calls", "sibling")]
    assert path_case(spark, up_down, "create", "sibling") == [["create", "sibling"]]
    ties = [("s", "calls", "b"), ("b", "calls", "t"), ("s", "publishes", "a"), ("t", "consumes", "a"), ("b", "calls", "s")]
    assert path_case(spark, ties, "s", "t") == [["s", "b", "t"], ["s", "a", "t"]]
    assert path_case(spark, [("create", "calls", "payment")], "payment", "create", "failure-propagation") == [["payment", "create"]]
    assert path_case(spark, [("create", "writes", "t"), ("reader", "reads", "t")], "create", "reader", "data-lineage") == [["create", "t", "reader"]]


def test_path_outcomes_and_evidence(spark):
    nodes, edges = nodes_of(spark, ["a", "b", "c"]), edges_of(spark, [("a", "calls", "b")])
    pairs = spark.createDataFrame([("a", "b"), ("a", "gone"), ("a", "a"), ("a", "c")], "src string, dst string")
    evidence = lambda source: spark.createDataFrame([("e", "a|calls|b", source, "observed", None)], "id string, edge string, source string, strength string, valid_until timestamp")
    told = lambda source, query: {(r.src, r.dst): r.outcome for r in paths.classify(edges, evidence(source), nodes, pairs, query).collect()}
    assert told("CODE", "runtime-observed") == {("a", "b"): "runtime-evidence-gap", ("a", "gone"): "missing-endpoint", ("a", "a"): "same-endpoint", ("a", "c"): "disconnected"}
    assert told("RUNTIME", "runtime-observed")["a", "b"] == "found"
    assert paths.eligible_evidence(evidence("CODE"), "proven").count() == 0
    stale = evidence("CODE").withColumn("valid_until", F.to_timestamp(F.lit("2024-01-01")))
    assert paths.eligible_evidence(stale, include_stale=False, now="2025-01-01").count() == 0 and paths.eligible_evidence(stale).count() == 1


# Ranking and projection


def test_relevance(spark):
    schema = "node string, label string, node_kind string, edge_kind string, node_pr string, edge_pr string, sync boolean, depth int, finding boolean, degree long, own_from string, own_to string, runtime double"
    rows = [("changed", "changed", "function", "calls", "added", None, True, 1, False, 1, None, None, None), ("busy", "busy", "function", "calls", None, None, True, 2, False, 15, None, None, None), ("ext", "ext", "external", "calls", None, None, True, 1, False, 1, "x", "y", 1.0)]
    got = {r.node: (round(r.score, 6), r.reason) for r in ranking.with_score(spark.createDataFrame(rows, schema)).collect()}
    low = round(math.log(2) / math.log(20), 6)
    assert got["changed"] == (round(17 + low, 6), "Ranked by change + direct.") and got["busy"][0] == round(4 + math.log(16) / math.log(20), 6) and math.isclose(got["ext"][0], 8 + 5 + 3.6 + 3 + 3 + low, abs_tol=1e-5)
    assert spark.range(1).select(ranking.runtime_signal(F.lit(1e6), *[F.lit(None).cast("double")] * 4)).first()[0] == 1
    assert [r[0] for r in spark.createDataFrame([(1400.0,), (100.0,), (1.0,), (0.0,)], "rpm double").select(ranking.traffic_class(F.col("rpm"))).collect()] == ["high", "medium", "low", None]


def test_frontier_groups_fold_a_remainder(spark):
    sizes = {"payments": 48, "b": 31, "c": 21, "d": 10, "e": 8, "f": 5, "g": 4}
    rows = [("root", pkg, 1.0, 1) for pkg, n in sizes.items() for _ in range(n)]
    groups = ranking.frontier_groups(spark.createDataFrame(rows, "root string, pkg string, score double, evidence long"), 5).orderBy(F.asc("remainder"), F.desc("score")).collect()
    assert len(groups) == 5 and (groups[0].value, groups[0].members) == ("payments", 48) and groups[-1].remainder and sum(g.members for g in groups) == 127


def view(spark, nodes, edges, **request):
    rows = projection.project(nodes_of(spark, nodes), edges_of(spark, edges), ProjectionRequest(**request)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.kind].append(r)
    return {r.id for r in by["node"]}, by


def test_views(spark):
    star = [("root", "calls", f"n{k}") for k in range(7)]
    seen, by = view(spark, ["root", *[f"n{k}" for k in range(7)]], star, roots=("root",), upstream=0, downstream=1, branch=2)
    assert len(seen) == 3 and [r.hidden for r in by["frontier"]] == [5]
    line = [("root", "calls", "middle"), ("middle", "calls", "beyond")]
    assert view(spark, ["root", "middle", "beyond"], line, roots=("root",), upstream=0, downstream=1)[0] == {"root", "middle"}
    wide = view(spark, ["root", "middle", "beyond"], line, roots=("root",), upstream=0, downstream=1, expansions={"downstream:middle:downstream dependencies": 1})
    assert wide[0] == {"root", "middle", "beyond"}
    assert view(spark, ["consumer", ("topic", "topic")], [("consumer", "consumes", "topic")], roots=("topic",), projection="data flow", upstream=0, downstream=1)[0] == {"consumer", "topic"}
    seen, by = view(spark, [(f"n{k:02d}", "package") for k in range(60)], [], roots=("missing",))
    assert len(seen) == 30 and [w.id for w in by["warning"]] == ["missing-root"]
    assert view(spark, ["root", "next", "reference"], [("root", "calls", "next")], roots=("root",), pins=("reference",), upstream=0, downstream=1, budget=3)[0] == {"root", "next", "reference"}
    assert view(spark, ["root", "b", "c"], [("b", "calls", "root"), ("root", "calls", "b"), ("root", "calls", "c")], roots=("root",), upstream=1, downstream=1, budget=3)[0] == {"root", "b", "c"}


def test_views_drill_down(spark):
    callers = [(f"{s}-{k}", "function", f"{s}-pkg-{k % 2}", s) for s in ("payments", "checkout", "fulfillment") for k in range(8)]
    edges = [(c[0], "calls", "utility") for c in callers]
    request = {"roots": ("utility",), "upstream": 1, "downstream": 0, "branch": 4}
    seen, by = view(spark, ["utility", *callers], edges, **request)
    group = next(r.id for r in by["frontier"] if r.id.endswith(":payments"))
    assert seen == {"utility"} and len(by["frontier"]) == 3
    seen, by = view(spark, ["utility", *callers], edges, **request, expansions={group: 1})
    child = next(r.id for r in by["frontier"] if "payments-pkg-0" in r.id)
    seen, _ = view(spark, ["utility", *callers], edges, **request, expansions={group: 1, child: 1})
    assert len(seen) > 1 and all(n == "utility" or n.startswith("payments-") for n in seen)


def test_views_keep_what_the_other_direction_shows(spark):
    shared = [(n, "function", None, "shared") for n in ("b", *[f"s{k}" for k in range(8)])]
    edges = [("b", "calls", "root"), ("root", "calls", "b"), ("b", "calls", "c"), *[("root", "calls", f"s{k}") for k in range(8)]]
    assert view(spark, ["root", "c", *shared], edges, roots=("root",), upstream=1, downstream=2, branch=4, budget=3)[0] == {"root", "b", "c"}


def test_views_obey_the_evidence_policy(spark):
    evidence = spark.createDataFrame([("1", "a|calls|b", "CODE", "proven", None), ("2", "b|calls|c", "CODE", "observed", None)], "id string, edge string, source string, strength string, valid_until timestamp")
    rows = projection.project(nodes_of(spark, ["a", "b", "c"]), edges_of(spark, [("a", "calls", "b"), ("b", "calls", "c")]), ProjectionRequest(roots=("a",), downstream=3, evidence_level="proven"), evidence).collect()
    assert {r.id for r in rows if r.kind == "node"} == {"a", "b"}


# Overlays


def test_overlays(spark):
    edges = spark.createDataFrame([("1", ["x", "gone"]), ("2", []), ("3", None), ("4", None)], "id string, refs array<string>")
    evidence = spark.createDataFrame([("x", "1", "proven"), ("y", "2", "proven"), ("z", "3", "observed")], "id string, edge string, strength string")
    assert {tuple(r) for r in overlays.edge_evidence(edges, evidence).collect()} == {("1", "x", "proven"), ("3", "z", "observed"), ("4", "legacy:4", "inferred")}
    graph_ = edges_of(spark, [("a", "calls", "a"), ("a", "calls", "b")])
    assert {tuple(r) for r in overlays.adjacency(nodes_of(spark, ["a", "b", "c"]), graph_).collect()} == {("a", 1, 2, 2), ("b", 1, 0, 1), ("c", 0, 0, 0)}
    members = spark.createDataFrame([("r", "1"), ("r", "2"), ("s", "3")], "rep string, id string")
    assert {tuple(r) for r in overlays.status_of(members, spark.createDataFrame([("1", "modified"), ("2", "removed")], "id string, status string")).collect()} == {("r", "removed")}
    rows, delta = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("b", "added"), ("c", "removed")], "id string, status string")
    assert {r.id for r in overlays.side(rows, delta, "base").collect()} == {"a", "c"} and {r.id for r in overlays.side(rows, delta, "head").collect()} == {"a", "b"}
    legacy = overlays.upgrade_legacy(spark.createDataFrame([("a", "removed"), ("b", None), ("c", "added")], "id string, pr string"))
    assert {(r.id, r.before, r.after) for r in legacy.collect()} == {("a", True, False), ("c", False, True)}


def test_fingerprints_see_content_not_order(spark):
    schema = "kind string, label string, pkg string, owners array<string>, tags array<string>, meta map<string,string>"
    rows = spark.createDataFrame([("f", "a", None, ["x", "y"], None, None), ("f", "a", None, ["y", "x"], [], None), ("f", "a", None, ["y"], [], None)], schema)
    prints = [r.fp for r in rows.select(overlays.node_fingerprint(*[F.col(c) for c in rows.columns]).alias("fp")).collect()]
    assert prints[0] == prints[1] != prints[2]
    whole = lambda *x: overlays.snapshot_fingerprint(spark.createDataFrame([(v,) for v in x], "fp string"))
    assert whole(*prints) == whole(*reversed(prints)) != whole(*prints[:2])


def test_crossings_and_ports(spark):
    rows = [("1", "a", "b", 0, 0, 10, 10), ("2", "c", "d", 0, 10, 10, 0), ("3", "a", "e", 0, 10, 10, 0), ("4", "f", "g", 20, 0, 30, 1)]
    segments = spark.createDataFrame([(i, s, t, *map(float, xy)) for i, s, t, *xy in rows], "id string, source string, target string, ax double, ay double, bx double, by double")
    assert {tuple(r) for r in overlays.crossings(segments, 3.0).collect()} == {("1", "2")}
    ports = {r.id: (r.family, r.lane) for r in overlays.edge_ports(spark.createDataFrame([("1", "calls", None), ("2", "calls", "persistence"), ("3", "publishes", None), ("4", "owns", None), ("5", "calls", "network")], "id string, kind string, boundary string")).collect()}
    assert ports == {"1": ("control", 0), "2": ("data", 1), "3": ("async", 2), "4": ("ownership", 3), "5": ("control", 0)}
    assert overlays.routing_decision(5, 8, 6, [0.9, 1, 1], 50) == "evaluate-router" and overlays.routing_decision(4, 8, 0, [1, 1, 1], 1) == "retain-layout"


# Requests


def test_commands_and_history(tmp_path):
    nodes = {"a", "b", "c", *map(str, range(6))}
    state = investigation.apply(investigation.State(), [{"command": "focus", "node": "a"}, {"command": "set-depth", "upstream": "all", "downstream": 2}, {"command": "pin", "node": "b"}, {"command": "include", "kind": "tests"}, {"command": "exclude", "kind": "calls"}], nodes)
    assert (state.focal, state.upstream, state.pins) == ("a", None, ("b",)) and investigation.relationships(state) == ["depends_on", "tests"]
    for bad in ({"command": "nothing"}, {"command": "focus", "node": "zz"}, {"command": "set-depth", "upstream": 9, "downstream": 1}, {"command": "set-projection", "projection": "x"}):
        with pytest.raises(investigation.CommandError):
            investigation.apply(state, [bad], nodes)
    with pytest.raises(investigation.CommandError, match="pins"):
        investigation.apply(state, [{"command": "pin", "node": str(k)} for k in range(5)], nodes)
    past = investigation.History(investigation.State(focal="a"))
    for focal in ("b", "b", "c"):
        past.push(investigation.State(focal=focal))
    assert past.breadcrumbs() == ["a", "b", "c"] and past.undo().focal == "b" and past.redo().focal == "c"
    for k in range(200):
        past.push(investigation.State(focal=str(k)))
    assert len(past.past) == investigation.MOST_UNDO
    assert investigation.focal_of(investigation.State(focal="gone", pins=("x", "c")), nodes, "a") == "c"
    views = [investigation.SavedView("One", "r", state), investigation.SavedView("one", "r", investigation.State(focal="c")), investigation.SavedView("B", "r", state)]
    investigation.save_views(views, str(tmp_path / "v.json"))
    assert [(v.name, v.state.focal) for v in investigation.load_views(str(tmp_path / "v.json"))] == [("B", "a"), ("one", "c")]


def test_registry_is_closed():
    from graphloom import schema

    assert all(set(kinds) <= set(schema.EDGE_KINDS) for kinds in PROJECTIONS.values()) and len(schema.NODE_KINDS) == 14 and len(schema.EDGE_KINDS) == 11
    assert len(list(itertools.chain(*[s.names for s in (schema.NODE, schema.EDGE, schema.EVIDENCE)]))) > 30


def test_fingerprints_are_filled_in(spark, tmp_path):
    from graphloom.sources.store import Store

    kept = Store(spark, str(tmp_path / "store"))
    nodes = lambda *ids: spark.createDataFrame([(x, "package", x) for x in ids], "id string, kind string, label string")
    first, again, other = kept.save("r", "index", "c0", nodes=nodes("a", "b")), kept.save("r", "index", "c1", nodes=nodes("b", "a").repartition(2)), kept.save("r", "index", "c2", nodes=nodes("a"))
    assert kept.backfill() == [first, again, other] and kept.backfill() == []
    told = {r.snapshot_id: r.fingerprint for r in kept.fingerprints().collect()}
    assert told[first] == told[again] != told[other] and all(len(x) == 64 for x in told.values())
    # a manifest of an earlier version: no storage_bytes
    kept.snapshots().drop("storage_bytes").write.parquet(str(tmp_path / "old" / "snapshots"))
    old = Store(spark, str(tmp_path / "old"))
    assert old.snapshots().count() == 3 and old.snapshots().where("storage_bytes is null").count() == 3 and old.current("r") == other


def test_frontiers_are_grouped_by_the_first_dimension_that_any_has(spark):
    schema = "root string, node string, edge_kind string, node_kind string, score double, pkg string, service string, owner string, load double, within_depth boolean, evidence_ids array<string>"
    one = [("r", f"n{k}", "writes" if k % 3 else "calls", "function", 1.0, f"p{k % 4}", None, None, None, k != 5, ["shared", f"e{k}"]) for k in range(8)]
    two = [("s", "a", "calls", "function", 0.5, None, None, None, 1400.0, None, None), ("s", "b", "calls", "topic", None, None, None, None, 0.0, True, [])]
    rows = spark.createDataFrame(one + two, schema)
    told = {(r.root, r.dimension, r.value): (r.members, r.within_depth, r.relations, r.evidence) for r in ranking.grouped_frontiers(rows, ["service", "package", "relation"], 3).collect()}
    assert told == {
        ("r", "package", "p0"): (2, True, "calls 1, writes 1", 3),
        ("r", "package", "p1"): (2, False, "writes 2", 3),
        ("r", "remainder", "remainder"): (4, True, "calls 2, writes 2", 5),
        ("s", "relation", "calls"): (2, True, "calls 2", 0),
    }
    values = lambda order: {(r.root, r.dimension, r.value): r.members for r in ranking.grouped_frontiers(rows, order, 6).collect()}
    assert values(["traffic", "relation"]) == {("s", "traffic", "high"): 1, ("s", "traffic", "low"): 1, ("r", "relation", "calls"): 3, ("r", "relation", "writes"): 5}
    assert values(["access"])[("r", "access", "ungrouped")] == 3 and values(["topic"])[("s", "topic", "b")] == 1
    assert values(["team"]) == values([]) and not ranking.grouped_frontiers(rows.limit(0), ["team"]).count()


@pytest.mark.parametrize("largest", [200_000, 40])
def test_frontiers_of_all_questions_are_those_of_each(spark, monkeypatch, largest):
    from graphloom.plans.catalog import _QUESTIONS, _grouping

    monkeypatch.setattr(ranking, "AT_ONCE", 30)
    monkeypatch.setattr(ranking, "LARGEST", largest)
    maps, rng = [], random.Random(7)
    monkeypatch.setattr(ranking, "materialize", lambda df, label="step", real=ranking.materialize: maps.append(df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")) or real(df, label))
    some = lambda *xs: rng.choice([None, *xs])
    rows = [
        (rng.choice("abcd") if k % 3 else "a", f"n{rng.randrange(40)}", rng.choice(["calls", "reads", "writes", "publishes", "owns"]), some("topic", "table"), some(0.5, 2.25, -3.0), some("s1", "s2", "ungrouped", "\u00e9"), some("p1", "p2", "p3", "p4"), some("t1"), some(5.0, 200.0, 3000.0), some(True, False), some([], ["e1"], ["e1", "e2", None], ["e3"]))
        for k in range(300)
    ]
    made = spark.createDataFrame(rows, "root string, node string, edge_kind string, node_kind string, score double, service string, pkg string, owner string, load double, within_depth boolean, evidence_ids array<string>").repartition(5)
    asked = {q: (PROJECTIONS[q], _grouping(q)) for q in _QUESTIONS} | {"topics": (["calls", "publishes"], ["topic"])}
    key = lambda r: (r.root, r.dimension, r.value, r.members, round(r.score, 9), r.within_depth, r.relations, r.evidence)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, "16")
    try:
        found = ranking.frontiers_by_question(made, asked, 3).collect()
    finally:
        spark.conf.unset(batch)
    told = Counter((r.question, *key(r)) for r in found)
    assert maps[0] == 1 and len(maps) == (2 if largest == 40 else 1)
    for question, (kinds, order) in asked.items():
        single = ranking.grouped_frontiers(made.where(made.edge_kind.isin(kinds)), order, 3).collect()
        assert single and Counter(key(r) for r in single) == Counter({k[1:]: n for k, n in told.items() if k[0] == question})
    assert not ranking.frontiers_by_question(made.limit(0), asked, 3).count()


def test_units_that_a_change_removes_are_reviewed(spark):
    ranked = lambda *rows: spark.createDataFrame(rows, "id string, priority int, region string")
    both = attention.overlay(ranked(("gone", 30, "protect"), ("kept", 10, "protect")), ranked(("kept", 60, "investigate"), ("new", 5, "low-attention")))
    touched = spark.createDataFrame([("gone", "removed", "n1", None)], "unit string, status string, node string, edge string")
    assert [(r.id, r.region, r.review_priority, r.statuses) for r in attention.review_units(both, touched).collect()] == [("gone", "protect", 32, "removed"), ("kept", "investigate", 60, ""), ("new", "low-attention", 5, "")]


def test_bare_edges_are_the_edges_by_their_ends(spark, tmp_path):
    """Unit facts read ends only: no label or count goes through an exchange, null keys make no edge."""
    from graphloom.plans.derived import Derived

    g = Derived(spark, "/root/testdata/sf0.001")
    columns = ["source", "kind", "target", "boundary"]
    want = sorted(map(tuple, g.edges.select(columns).collect()), key=str)
    assert sorted(map(tuple, g.bare_edges.select(columns).collect()), key=str) == want and len(want) > 0
    odd = tmp_path / "odd"
    for name in ("region", "nation", "customer", "supplier", "part"):
        g.table(name).write.parquet(f"{odd}/{name}.parquet")
    g.table("orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey"))).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority"))).write.parquet(f"{odd}/orders.parquet")
    g.table("lineitem").withColumn("l_suppkey", F.when(F.col("l_orderkey") % 5 > 0, F.col("l_suppkey"))).withColumn("l_returnflag", F.when(F.col("l_orderkey") % 2 > 0, F.col("l_returnflag"))).write.parquet(f"{odd}/lineitem.parquet")
    g = Derived(spark, str(odd))
    assert sorted(map(tuple, g.bare_edges.select(columns).collect()), key=str) == sorted(map(tuple, g.edges.select(columns).collect()), key=str)


def test_connected_pairs_are_those_with_a_path(spark, monkeypatch):
    """Random ways up, down and plain: the same pairs as the search for routes, which is asked for the few open ones only."""
    draw = random.Random(11)
    asked, search = [], paths.paths

    def counted(ways, pairs, most=3):
        asked.append(pairs.count())
        return search(ways, pairs, most)

    nodes = [f"n{k}" for k in range(9)]
    rows = [(f"{t}{a}", f"{t}{b}", f"{t}{k}", 1, 0, draw.choice(["up", "down", None])) for t in ("x|", "y|", "z|") for k in range(13) for a, b in [draw.sample(nodes, 2)]]
    # only by way of p twice: up to p, over q, and down from p
    rows += [("a", "p", "e1", 0, 0, "up"), ("p", "q", "e2", 1, 0, None), ("q", "p", "e3", 1, 0, None), ("p", "b", "e4", 0, 0, "down")]
    ways = spark.createDataFrame(rows, "at string, to string, edge string, cost int, penalty int, way string")
    pairs = spark.createDataFrame([(f"{t}{a}", f"{t}{b}") for t in ("x|", "y|", "z|") for a in nodes for b in nodes] + [("a", "b"), ("a", "q"), ("a", None)], "src string, dst string")
    want = sorted((r.src, r.dst) for r in search(ways, pairs, 1).collect())
    monkeypatch.setattr(paths, "paths", counted)
    assert sorted((r.src, r.dst) for r in paths.connected(ways, pairs).collect()) == want
    assert ("a", "q") in want and ("a", "b") not in want and 1 <= sum(asked) < len(want) / 2
