"""Strong components, covering tests and best paths against plain searches on small and on awkward graphs."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest

from graphloom.operators import covering, cycles, paths

EDGE = "id string, source string, kind string, target string"


def reached(pairs):
    after = defaultdict(set)
    for u, v in pairs:
        if u is not None and v is not None:
            after[u].add(v)
    found = {}
    for u in list(after):
        seen, todo = set(), [u]
        while todo:
            for v in after.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        found[u] = seen
    return found


def components(pairs):
    reach = reached(pairs)
    mutual = {u: {v for v in r if u in reach.get(v, ())} | {u} for u, r in reach.items()}
    return {(u, min(c), len(c)) for u, c in mutual.items() if len(c) > 1}


def ring(*names):
    return list(zip(names, names[1:] + names[:1]))


@pytest.mark.parametrize("seed", range(2))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n, m = rng.choice([(8, 14), (40, 60), (60, 75), (200, 260)])
    pairs = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
    found = cycles.strong_components(spark.createDataFrame(pairs, "u string, v string"))
    assert {tuple(r) for r in found.collect()} == components(pairs)


def test_components_that_hang_together(spark):
    """Rings in a row, rings that share no node, a loop, a repeated edge, nulls, and no edge at all."""
    rings = [ring(*(f"r{k}{x}" for x in "abc")) for k in range(6)]
    row = [(f"r{k}a", f"r{k + 1}b") for k in range(5)]
    tail = [(f"t{k}", f"t{k + 1}") for k in range(8)] + [("r5c", "t0")]
    pairs = [*itertools.chain(*rings), *row, *tail, ("x", "x"), ("r0a", "r0b"), (None, "r0a"), ("r0a", None), *ring("p", "q")]
    frame = spark.createDataFrame(pairs, "u string, v string")
    found = [tuple(r) for r in cycles.strong_components(frame).collect()]
    assert set(found) == components(pairs) and len(found) == 20
    assert cycles.strong_components(frame.where("u = v")).collect() == []


def test_tables_of_components_stay_small(spark, monkeypatch):
    """In a graph whose closure has 40,000 pairs no table has more rows than there are edges and nodes."""
    sizes, write = [], cycles.materialize

    def noted(df, label="step"):
        out = write(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(cycles, "materialize", noted)
    names = [f"n{k:03}" for k in range(200)]
    rng = random.Random(7)
    pairs = {*ring(*rng.sample(names, 200)), *((rng.choice(names), rng.choice(names)) for _ in range(600))}
    found = cycles.strong_components(spark.createDataFrame(list(pairs), "u string, v string"))
    assert found.count() == 200 and found.select("component").distinct().count() == 1
    assert max(sizes) <= len(pairs) + 200


def test_bitmaps_of_covering_tests(spark, monkeypatch):
    monkeypatch.setattr(covering, "BLOCK", 7)
    rng = random.Random(3)
    names = [f"f{k}" for k in range(40)]
    tests = [f"t{k}" for k in range(30)]
    nodes = spark.createDataFrame([(x, "function") for x in names] + [(x, "test") for x in [*tests, tests[0]]], "id string, kind string")
    ends = [(rng.choice(tests), "tests", rng.choice(names)) for _ in range(40)] + [(rng.choice(names), "calls", rng.choice(names)) for _ in range(50)] + [("f1", "calls", "t3"), ("t3", "tests", "f1"), ("f2", "reads", "f3"), ("t5", "calls", "gone")]
    edges = spark.createDataFrame([(f"e{k}", *e) for k, e in enumerate(ends)], "id string, source string, kind string, target string")
    reach = reached([(s, t) for s, k, t in ends if k in ("calls", "tests")])
    want = {(v, t) for t in tests for v in reach.get(t, ()) if v != t}
    got = [tuple(r) for r in covering.test_reachability(nodes, edges).collect()]
    assert set(got) == want and len(got) == len(want)
    counts = defaultdict(int)
    for v, _ in want:
        counts[v] += 1
    assert {tuple(r) for r in covering.covering_counts(nodes, edges).collect()} == set(counts.items())
    bitmaps, numbers = covering.covering_tests(nodes, edges)
    assert bitmaps.count() <= (len(names) + len(tests) + 1) * numbers.select("block").distinct().count()
    assert covering.covering_counts(nodes.where("kind = 'none'"), edges).collect() == []


def every_path(edges, policy, src, dst, most):
    ways = defaultdict(list)
    for id_, s, kind, t in edges:
        hold = kind in ("owns", "implements")
        if policy.get(kind) in ("forward", "both"):
            ways[s].append((id_, t, "down" if hold else None))
        if policy.get(kind) in ("reverse", "both"):
            ways[t].append((id_, s, "up" if hold else None))
    found = []

    def walk(node, nodes, ids, hops, last):
        if node == dst:
            found.append((hops, len(ids), ids, nodes))
            return
        for id_, to, way in ways[node]:
            if to not in nodes and not (last == "up" and way == "down"):
                walk(to, [*nodes, to], [*ids, id_], hops + (way is None), way)

    if src != dst:
        walk(src, [src], [], 0, None)
    return [(h, e, n) for h, _, e, n in sorted(found)[:most]]


@pytest.mark.parametrize(("seed", "query", "most"), [(0, "semantic-dependency", 4), (3, "failure-propagation", 3)])
def test_best_paths_are_those_of_an_exhaustive_search(spark, seed, query, most):
    rng = random.Random(seed)
    n = rng.choice([5, 6, 7])
    names, kinds = [f"n{k}" for k in range(n)], ["calls", "owns", "publishes", "consumes", "owns", "retries"]
    edges = [(f"e{k:02}", *e) for k, e in enumerate(sorted({(rng.choice(names), rng.choice(kinds), rng.choice(names)) for _ in range(2 * n + 3)}))]
    asked = list(itertools.product(names, names))
    frame = spark.createDataFrame(edges, EDGE)
    got = defaultdict(list)
    for r in paths.paths(paths.steps(frame, paths.POLICIES[query]), spark.createDataFrame(asked, "src string, dst string"), most).orderBy("rank").collect():
        got[r.src, r.dst].append((r.hops, r.edges, r.nodes))
    for src, dst in asked:
        assert got[src, dst] == every_path(edges, paths.POLICIES[query], src, dst, most), (src, dst)


def test_a_detour_that_hides_a_path(spark):
    """The cheapest way to turn down again passes a node twice; the path that does not is found."""
    edges = [("a1", "s", "calls", "m"), ("a2", "p", "owns", "m"), ("a3", "p", "owns", "d"), ("a4", "p", "calls", "x"), ("a5", "x", "calls", "p"), ("a6", "m", "calls", "y"), ("a7", "y", "calls", "z"), ("a8", "z", "calls", "w"), ("a9", "w", "calls", "d")]
    got = paths.paths(paths.steps(spark.createDataFrame(edges, EDGE), paths.POLICIES["semantic-dependency"]), spark.createDataFrame([("s", "d")], "src string, dst string"), 2).orderBy("rank").collect()
    assert [(r.hops, r.edges, r.nodes) for r in got] == every_path(edges, paths.POLICIES["semantic-dependency"], "s", "d", 2) != []


def test_dense_graphs_have_few_labels(spark, monkeypatch):
    sizes, write = [], paths.materialize

    def noted(df, label="step"):
        out = write(df, label)
        sizes.append(out.count() if label in ("labels", "parts", "pool") else 0)
        return out

    monkeypatch.setattr(paths, "materialize", noted)
    core = [f"c{k}" for k in range(10)]
    edges = [(f"{a}>{b}", a, "calls", b) for a, b in itertools.permutations(core, 2)] + [("t1", "c9", "calls", "x1"), ("t2", "x1", "calls", "x2"), ("t3", "x2", "calls", "x3")]
    got = paths.paths(paths.steps(spark.createDataFrame(edges, EDGE), paths.POLICIES["semantic-dependency"]), spark.createDataFrame([("c0", "x3")], "src string, dst string"), 4).collect()
    assert sorted(r.hops for r in got) == [4, 5, 5, 5] and sum(sizes) < 1000


def test_paths_from_one_start_are_those_of_an_exhaustive_search(spark):
    """With fewer starts than ends the mirrored graph is searched; packages hold most nodes, so best routes back pass them again."""
    rng = random.Random(5)
    fns = [f"f{k}" for k in range(6)]
    owns = [("s", "owns", f"p{k}") for k in range(3)] + [(f"p{k % 3}", "owns", f) for k, f in enumerate(fns)]
    calls = sorted({(rng.choice(fns), rng.choice(["calls", "publishes", "consumes"]), rng.choice(fns)) for _ in range(11)})
    edges = [(f"e{k:02}", *e) for k, e in enumerate(owns + calls)]
    asked = [("s", f"p{k}") for k in range(3)] + [("s", f) for f in fns[:2]]
    got = defaultdict(list)
    for r in paths.paths(paths.steps(spark.createDataFrame(edges, EDGE), paths.POLICIES["failure-propagation"]), spark.createDataFrame(asked, "src string, dst string"), 3).orderBy("rank").collect():
        got[r.src, r.dst].append((r.hops, r.edges, r.nodes))
    for src, dst in asked:
        assert got[src, dst] == every_path(edges, paths.POLICIES["failure-propagation"], src, dst, 3), (src, dst)


def test_only_near_states_are_settled(spark, monkeypatch):
    """Nodes that lie beyond the wanted routes, or lead to their ends without need, have no rows."""
    sizes, write = [], paths.materialize

    def noted(df, label="step"):
        out = write(df, label)
        sizes.append(out.count() if label == "togo" else 0)
        return out

    monkeypatch.setattr(paths, "materialize", noted)
    edges = [("a1", "s", "calls", "d1"), ("a2", "s", "calls", "d2")] + [(f"u{k}", f"x{k}", "calls", "s") for k in range(200)] + [(f"v{k}", "d1", "calls", f"y{k}") for k in range(200)]
    got = paths.paths(paths.steps(spark.createDataFrame(edges, EDGE), paths.POLICIES["semantic-dependency"]), spark.createDataFrame([("s", "d1"), ("s", "d2")], "src string, dst string"), 1).collect()
    assert sorted((r.dst, r.edges) for r in got) == [("d1", ["a1"]), ("d2", ["a2"])]
    assert 0 < max(sizes) <= 410  # 200 nodes one call away wait in both states, and none of the 200 callers is met
