"""Commit graphs against plain walks, updates of histories, and evidence of reach in the order of a search."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import commits, graph

COMMIT = "id string, commit string, parents array<string>, committed_at timestamp_ntz, occurred_at timestamp_ntz"
DAY0 = datetime.datetime(2024, 1, 1)


def walked(parents, ref):
    seen, todo = set(), [ref] if ref in parents else []
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += [p for p in parents[c] if p in parents]
    return seen


def frame(spark, parents):
    rows = [(f"git:{c}", c, p, *[DAY0 + datetime.timedelta(hours=k)] * 2) for k, (c, p) in enumerate(parents.items())]
    return spark.createDataFrame(rows, COMMIT)


def wild(seed, n):
    rng, made = random.Random(seed), {}
    for k in range(n):
        names = list(made)
        recent = names[-6:]
        made[f"c{k:03}"] = rng.sample(recent, min(len(recent), rng.choice([0, 1, 1, 1, 1, 1, 2, 2, 3]))) if k else []
    return made


@pytest.mark.parametrize("seed", [1, 2])
def test_ancestors_in_wild_graphs(spark, seed):
    parents = wild(seed, 70) | {"shallow": ["not there"], "on": ["shallow", "c010"]}
    made = commits.index(frame(spark, parents))
    assert made.places.count() == made.places.select("chain", "place").distinct().count() == len(parents)
    rng = random.Random(seed)
    for old, ref in [("c010", "on"), ("on", "on"), ("c003", "c069"), *(tuple(rng.sample(list(parents), 2)) for _ in range(3))]:
        new, had = walked(parents, ref), walked(parents, old)
        assert {r.commit for r in commits.ancestors(made, ref).collect()} == new
        assert {r.commit for r in commits.between(made, old, ref).collect()} == new - had
        assert commits.is_ancestor(made, old, ref) == (old in new)
    assert commits.ancestors(made, "unknown").collect() == [] and not commits.is_ancestor(made, "unknown", "on")


def test_long_lines_take_few_rounds(spark, monkeypatch):
    rounds, write = [], commits.materialize
    monkeypatch.setattr(commits, "materialize", lambda df, label="step": rounds.append(label) or write(df, label))
    made = commits.index(frame(spark, {f"c{k:04}": [f"c{k - 1:04}"] if k else [] for k in range(1500)}))
    assert commits.ancestors(made, "c1400").count() == 1401 and rounds.count("hops") <= 13 and rounds.count("upto") == 1


def test_updates_read_what_is_new(spark):
    parents = {"a": [], "b": ["a"], "x": ["a"], "c": ["b"], "m": ["c", "x"], "d": ["m"], "z": []}
    rows = frame(spark, parents).withColumn("summary", F.lit("read"))
    made, now = commits.index(rows), F.lit(DAY0 + datetime.timedelta(days=2)).cast("timestamp_ntz")
    kept = commits.read_history(made, rows, "b", now - F.make_dt_interval(F.lit(9))).withColumn("summary", F.lit("kept"))

    def update(previous, before, days, ref="d", window=9):
        found, short = commits.update_history(made, rows, previous, before, days, ref, window, now)
        return [(r.commit, r.summary) for r in found.collect()], short

    assert update(kept, "b", 9) == ([("d", "read"), ("c", "read"), ("x", "read"), ("b", "kept"), ("a", "kept")], True)
    everything = [(c, "read") for c in "dcxba"]
    assert update(kept, "b", 8) == update(kept, "z", 9) == update(kept, "HEAD", 9) == update(None, None, None) == (everything, False)
    assert update(kept, "b", 9, "HEAD") == ([], False)
    with pytest.raises(ValueError):
        update(kept, "b", 9, window=0)


def test_evidence_of_reach_is_in_the_order_of_a_search(spark):
    rng = random.Random(4)
    units = [f"u{k:02}" for k in range(24)]
    arcs = sorted({(f"e{rng.randrange(1000):03}", rng.choice(units), rng.choice(units[: 4 + k % 20])) for k in range(70)} | {("e1", "u03", "u03")})
    arcs = [x for n, x in enumerate(arcs) if not n or arcs[n - 1][0] != x[0]]
    into, found = {}, set()
    for e, u, v in arcs:
        if u != v:
            into.setdefault(v, []).append((e, u))
    for most in (3, 7, 50):
        want = set()
        for root in units:
            queue, edges = [root], []
            for unit in queue:
                edges += sorted(e for e, _ in into.get(unit, ()))
                queue += sorted({u for _, u in into.get(unit, ())} - set(queue))
            want |= {(root, k, e) for k, e in enumerate(edges[:most], 1)}
        got = graph.reach_evidence(spark.createDataFrame(arcs, "id string, u string, v string"), spark.createDataFrame([(u,) for u in units], "id string"), most)
        found = {tuple(r) for r in got.collect()}
        assert found == want
    assert len(found) > 200
