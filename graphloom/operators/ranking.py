"""Relevance of neighbours, frontier categories and groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import materialize

#: Candidates that a task groups at once, and those of one frontier that it holds for this; larger frontiers are grouped in sorts that spill.
AT_ONCE, LARGEST = 50_000, 200_000

# Weights of signals, priorities of kinds, kinds that matter to an architecture.
WEIGHTS = {"change": 9, "direct": 8, "runtime": 5, "contract": 5, "failure": 4, "ownership": 3, "architecture": 3, "structural": 1}
RELATIONS = ["calls", "writes", "publishes", "consumes", "reads", "retries", "tests", "depends_on", "transforms", "owns", "implements"]
KINDS = {"endpoint": 0, "transaction": 1, "external": 2, "contract": 3, "table": 4, "topic": 5, "cache": 6, "function": 7, "method": 7, "service": 8, "package": 9, "test": 10, "database": 11, "broker": 11}
SIGNIFICANT = ["endpoint", "transaction", "external", "table", "topic", "contract", "database", "broker"]


def _unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def runtime_signal(rpm: Column, qps: Column, p99: Column, error_rate: Column, lag: Column) -> Column:
    """0 to 1: the strongest of traffic, latency, errors and lag; 0 without telemetry."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    traffic = F.log(1 + zero(rpm) + zero(qps) * 60) / F.log(F.lit(10001.0))
    return _unit(F.greatest(traffic, zero(p99) / 1000, zero(error_rate) / 5, zero(lag) / 10000))


def signals() -> dict[str, Column]:
    """Over a candidate row: node_kind, edge_kind, node_pr, edge_pr, sync, depth, finding, degree, own_from, own_to, runtime."""
    node, edge = F.col("node_kind"), F.col("edge_kind")
    finding = F.coalesce("finding", F.lit(False))
    return {
        "change": F.when(F.col("node_pr").isNotNull(), 1.0).when(F.col("edge_pr").isNotNull(), 0.9).otherwise(0.0),
        "direct": F.when(F.col("depth") <= 1, 1.0).otherwise(1 / F.greatest(F.lit(2), F.col("depth"))),
        "runtime": F.coalesce("runtime", F.lit(0.0)),
        "contract": F.when(node == "contract", 1.0).when((edge == "implements") | (node == "topic") & edge.isin("publishes", "consumes"), 0.65).otherwise(0.0),
        "failure": F.when(edge == "retries", 1.0).when((node == "external") & F.coalesce("sync", F.lit(True)), 0.9).when(edge.isin("writes", "publishes"), 0.55).when(finding, 0.7).otherwise(0.0),
        "ownership": F.when(F.col("own_from").isNotNull() & F.col("own_to").isNotNull() & (F.col("own_from") != F.col("own_to")), 1.0).otherwise(0.0),
        "architecture": F.when(node.isin(SIGNIFICANT), 1.0).when(finding, 0.75).otherwise(0.0),
        "structural": _unit(F.log(1.0 + F.col("degree")) / F.log(F.lit(20.0))),
    }


def with_score(candidates: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """Candidates with ``score`` and the two leading signals as ``reason``."""
    w = weights or WEIGHTS
    told = {k: x * w[k] for k, x in signals().items() if w.get(k)}
    led = F.filter(F.array_sort(F.array(*[F.struct((-x).alias("loss"), F.lit(k).alias("signal")) for k, x in told.items()])), lambda p: p["loss"] < 0)
    names = F.array_join(F.slice(F.transform(led, lambda p: p["signal"]), 1, 2), " + ")
    score = sum((F.greatest(x, F.lit(0.0)) for x in told.values()), F.lit(0.0))  # a plain sum: candidates are many
    return candidates.withColumns({"score": score, "reason": F.when(F.size(led) > 0, F.concat(F.lit("Ranked by "), names, F.lit("."))).otherwise(F.concat(F.lit("Reachable at semantic depth "), F.col("depth"), F.lit(".")))})


def order() -> list[Column]:
    relation = F.array_position(F.array(*map(F.lit, RELATIONS)), F.col("edge_kind"))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("node_kind"))
    return [F.desc("score"), F.col("depth"), relation, kind, F.col("label"), F.col("node")]


def top(candidates: DataFrame, most: int = 8, by: str = "root") -> DataFrame:
    """The ``most`` candidates of each ``by``, with their rank."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order()))).where(F.col("rank") <= most)


def category(kind: Column, upstream: Column) -> Column:
    up = lambda a, b: F.when(upstream, a).otherwise(b)
    return (
        F.when(upstream & (kind == "calls"), "callers").when(kind == "consumes", "event consumers").when(kind == "publishes", up("event publishers", "published events"))
        .when(kind == "reads", up("database readers", "data dependencies")).when(kind == "writes", up("database writers", "data dependencies")).when(kind == "tests", "tests")
        .when(kind == "depends_on", up("dependencies", "dependents")).otherwise(up("upstream dependencies", "downstream dependencies"))
    )


def traffic_class(rpm: Column) -> Column:
    return F.when(rpm >= 1000, "high").when(rpm >= 100, "medium").when(rpm > 0, "low")


def dimensions() -> dict[str, Column]:
    """What groups are made by, over a candidate row: service, pkg, owner, edge_kind, node, node_kind, load; null where it has none."""
    relation, load = F.col("edge_kind"), F.col("load")
    topic = F.when(F.col("node_kind") == "topic", F.col("node")).when(relation.isin("publishes", "consumes"), relation)
    traffic = F.when(load >= 1000, "high").when(load >= 100, "medium").when(load.isNotNull(), "low")
    return {"service": F.col("service"), "package": F.col("pkg"), "team": F.col("owner"), "relation": relation, "topic": topic, "access": F.when(relation.isin("reads", "writes"), relation), "traffic": traffic}


def grouped_frontiers(candidates: DataFrame, order_by: list[str], most: int = 6, by: str = "root") -> DataFrame:
    """(by, dimension, value, members, score, within_depth, relations, evidence): the groups of each frontier.

    A frontier is grouped by the first dimension of ``order_by`` that any of its
    candidates has, by relation if none; candidates without it are "ungrouped".
    Beyond ``most`` groups (2 at least) the last ones are the remainder, of all
    candidates whose node is in one of them. ``relations`` has the candidates of
    each relation, ``evidence`` the number of distinct ``evidence_ids``: evidence
    that members share counts once. A null score or depth flag is 0 or true; null
    and empty lists have no evidence. Candidates are exchanged once, by ``by``, and
    what their groups tell is read beside them in sorts that spill.
    """
    most, of = max(2, most), dimensions()
    names = list(dict.fromkeys([*order_by, "relation"]))
    rows = candidates.select(by, "node", "edge_kind", "score", "within_depth", "evidence_ids", *[of[d].alias(f"by_{d}") for d in names])
    whole = Window.partitionBy(by)
    rows = rows.withColumn("dimension", F.coalesce(*[F.when(F.count(f"by_{d}").over(whole) > 0, F.lit(d)) for d in order_by], F.lit("relation")))
    rows = rows.withColumn("value", F.coalesce(*[F.when(F.col("dimension") == d, F.col(f"by_{d}")) for d in names], F.lit("ungrouped"))).drop(*[f"by_{d}" for d in names])
    weight = lambda best, n: F.greatest(F.lit(0.0), F.coalesce(best, F.lit(0.0))) + F.log(1.0 + n) * 0.25
    group = Window.partitionBy(by, "value")
    rows = rows.withColumn("weight", F.round(weight(F.max("score").over(group), F.count("*").over(group)), 9))
    rows = rows.withColumn("place", F.dense_rank().over(whole.orderBy(F.desc("weight"), "value")))
    rows = rows.withColumn("rest", (F.max("place").over(whole) > most) & (F.col("place") >= most))
    rows = rows.withColumn("folded", F.max("rest").over(Window.partitionBy(by, "node")))
    own = F.when(~F.col("rest"), F.struct("dimension", "value"))
    last = F.when(F.col("folded"), F.struct(F.lit("remainder").alias("dimension"), F.lit("remainder").alias("value")))
    members = rows.select(by, "edge_kind", "score", "within_depth", "evidence_ids", F.explode(F.array_compact(F.array(own, last))).alias("g")).select(by, "g.dimension", "g.value", "edge_kind", "score", "within_depth", "evidence_ids")
    key = [by, "dimension", "value"]
    kinds = members.groupBy(*key, "edge_kind").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min(F.coalesce("within_depth", F.lit(True))).alias("within"))
    mix = F.array_join(F.array_sort(F.collect_list(F.concat("edge_kind", F.lit(" "), "n"))), ", ")
    told = kinds.groupBy(*key).agg(F.sum("n").alias("members"), weight(F.max("best"), F.sum("n")).alias("score"), F.min("within").alias("within_depth"), mix.alias("relations"))
    proof = members.select(*key, F.explode("evidence_ids").alias("e")).distinct().groupBy(*key).agg(F.count("e").alias("evidence"))
    return told.join(proof, key, "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)).cast("long"))


def frontiers_by_question(candidates: DataFrame, asked: dict[str, tuple[list[str], list[str]]], most: int = 6, by: str = "root") -> DataFrame:
    """(question, by, dimension, value, members, score, within_depth, relations, evidence): ``grouped_frontiers`` of each question, over the candidates of its edge kinds.

    asked: edge kinds and dimensions of each question. Candidates are exchanged and sorted once, by
    ``by``, and tasks group whole frontiers for all questions. Frontiers of more than ``LARGEST``
    candidates are only named there, and grouped as one question at a time.
    """
    most, of = max(2, most), dimensions()
    names = list(dict.fromkeys([d for _, order_by in asked.values() for d in order_by] + ["relation"]))
    kinds = list(dict.fromkeys(k for of_question, _ in asked.values() for k in of_question))
    rows = candidates.where(F.col("edge_kind").isin(kinds))
    told = rows.select(F.col(by).alias("by"), "node", "edge_kind", F.col("score").cast("double").alias("score"), "within_depth", "evidence_ids", *[of[d].alias(f"by_{d}") for d in names])
    # by a hash of its own: an exchange that a join below has made already may be taken back while the plan runs
    told = told.repartition(F.xxhash64("by")).sortWithinPartitions("by")
    schema = f"question string, by {candidates.schema[by].dataType.simpleString()}, dimension string, value string, members long, score double, within_depth boolean, relations array<string>, evidence long"
    at_once, largest = AT_ONCE, LARGEST

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, whole in _whole_frontiers(batches, at_once, largest):
            if whole:
                yield from _grouped(table, asked, most)
            else:
                nothing = [pa.nulls(1, t) for t in (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.string()), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), table["by"].slice(0, 1).combine_chunks(), *nothing], _TOLD)

    told = materialize(told.mapInArrow(read, schema), "told")
    large = told.where("question is null").select(F.col("by").alias(by)).distinct()
    found = told.where("question is not null").withColumn("relations", F.array_join(F.array_sort("relations"), ", ")).withColumnRenamed("by", by)
    if not large.isEmpty():
        rest = materialize(rows.join(F.broadcast(large), rows[by].eqNullSafe(large[by]), "left_semi"), "large")
        for question, (of_question, order_by) in asked.items():
            wide = grouped_frontiers(rest.where(F.col("edge_kind").isin(of_question)), order_by, most, by)
            found = found.unionByName(wide.withColumn("question", F.lit(question)))
    return found


_TOLD = ["question", "by", "dimension", "value", "members", "score", "within_depth", "relations", "evidence"]


def _coded(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A code for each value, null being one of them, and the values by code."""
    found = values.combine_chunks().dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def _whole_frontiers(batches: Iterator[pa.RecordBatch], at_once: int, largest: int) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole frontiers, from rows sorted by ``by``; of a frontier larger than ``largest`` a row that names it."""
    held, size, passed = [], 0, None
    for batch in batches:
        if passed is not None:  # the rest of a large frontier
            code, _ = _coded(pa.chunked_array([passed, batch["by"]]))
            batch = batch.slice(int(np.argmax(np.append(code[1:] != code[0], True))))
        if not batch.num_rows:
            continue
        passed, size = None, size + batch.num_rows
        held.append(batch)
        if size < at_once:
            continue
        table = pa.Table.from_batches(held)
        code, _ = _coded(table["by"])
        others = np.flatnonzero(code != code[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield table.slice(0, cut), True
        held, size = table.slice(cut).to_batches(), size - cut
        if size > largest:
            yield table.slice(cut, 1), False
            passed, held, size = table["by"].slice(cut, 1).combine_chunks(), [], 0
    if held:
        yield pa.Table.from_batches(held), True


def _grouped(table: pa.Table, asked: dict[str, tuple[list[str], list[str]]], most: int) -> Iterator[pa.RecordBatch]:
    """The groups of whole frontiers, a batch for each question, as ``grouped_frontiers`` tells them."""
    root, roots = _coded(table["by"])
    node, nodes = _coded(table["node"])
    kind, kinds = _coded(table["edge_kind"])
    lists = table["evidence_ids"].combine_chunks()
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    proof, proofs = _coded(pa.chunked_array([lists.flatten()]))
    begins, known = np.cumsum(sizes) - sizes, np.array(proofs.is_valid(), dtype=bool)
    score = table["score"].combine_chunks().fill_null(-np.inf).to_numpy()
    within = table["within_depth"].combine_chunks().fill_null(True).to_numpy(zero_copy_only=False)
    told = {c.removeprefix("by_"): _coded(table[c]) for c in table.column_names if c.startswith("by_")}
    words = sorted({w for _, values in told.values() for w in values.to_pylist() if w is not None} | {"ungrouped"})
    places, v = {w: i for i, w in enumerate(words)}, len(words)
    told = {d: np.array([places.get(w, -1) for w in values.to_pylist()], dtype=np.int64)[code] for d, (code, values) in told.items()}
    words, none = pa.array([*words, "remainder"]), places["ungrouped"]

    def best(at: np.ndarray, of: np.ndarray, n: np.ndarray) -> np.ndarray:
        found = np.full(len(n), -np.inf)
        np.maximum.at(found, of, score[at])
        return np.maximum(0.0, found) + np.log(1.0 + n) * 0.25

    for question, (of_question, order_by) in asked.items():
        rows = np.flatnonzero(np.isin(kind, [i for i, k in enumerate(kinds.to_pylist()) if k in of_question]))
        if not len(rows):
            continue
        r, names = root[rows], list(dict.fromkeys([*order_by, "relation"]))
        chosen = np.full(len(roots), names.index("relation"))
        for d in reversed(order_by):
            chosen[r[told[d][rows] >= 0]] = names.index(d)
        value = np.choose(chosen[r], [told[d][rows] for d in names])
        value[value < 0] = none
        group, g, n = np.unique(r * v + value, return_inverse=True, return_counts=True)
        weight, of_root = np.round(best(rows, g, n), 9), group // v
        order = np.lexsort((group, np.where(np.isnan(weight), -np.inf, -weight), of_root))
        many = np.bincount(of_root, minlength=len(roots))
        place = np.empty(len(group), dtype=np.int64)
        place[order] = np.arange(len(group)) - (np.cumsum(many) - many)[of_root[order]] + 1
        rest = ((many[of_root] > most) & (place >= most))[g]
        pair, p = np.unique(r * len(nodes) + node[rows], return_inverse=True)
        folded = np.zeros(len(pair), dtype=bool)
        folded[p[rest]] = True
        own, last = np.flatnonzero(~rest), np.flatnonzero(folded[p])
        at = rows[np.concatenate([own, last])]
        final, f, n = np.unique(np.concatenate([r[own] * (v + 1) + value[own], r[last] * (v + 1) + v]), return_inverse=True, return_counts=True)
        inside = np.ones(len(final), dtype=bool)
        np.logical_and.at(inside, f, within[at])
        mixed, m = np.unique(f * len(kinds) + kind[at], return_counts=True)
        texts = pa.compute.binary_join_element_wise(kinds.take(pa.array(mixed % len(kinds))), pa.array(m).cast(pa.string()), " ")
        ends = np.searchsorted(mixed // len(kinds), np.arange(len(final) + 1)).astype(np.int32)
        each = np.repeat(np.arange(len(at)), sizes[at])
        e = proof[begins[at][each] + np.arange(len(each)) - (np.cumsum(sizes[at]) - sizes[at])[each]] if len(each) else each
        seen = np.unique(f[each] * len(proofs) + e)
        seen = seen[known[seen % len(proofs)]] if len(seen) else seen
        evidence = np.bincount(seen // max(1, len(proofs)), minlength=len(final))
        of_root, of_value = final // (v + 1), final % (v + 1)
        dimension = pa.array([*names, "remainder"]).take(pa.array(np.where(of_value == v, len(names), chosen[of_root])))
        columns = [pa.array([question] * len(final)), roots.take(pa.array(of_root)), dimension, words.take(pa.array(of_value)), pa.array(n), pa.array(best(at, f, n)), pa.array(inside), pa.ListArray.from_arrays(pa.array(ends), texts), pa.array(evidence)]
        yield pa.RecordBatch.from_arrays(columns, _TOLD)


def frontier_groups(candidates: DataFrame, most: int = 6, dimension: str = "pkg", by: str = "root") -> DataFrame:
    """(by, value, members, score, evidence): groups of candidates, the last ones folded into a remainder.

    A group's score is its best member's and a quarter of ln(1 + members). With
    more groups than ``most`` (2 at least) the last is the remainder.
    """
    most = max(2, most)
    value = F.coalesce(F.col(dimension), F.lit("ungrouped"))
    score = F.max("score") + F.log(1.0 + F.count("*")) * 0.25
    groups = candidates.groupBy(by, value.alias("value")).agg(F.count("*").alias("members"), F.max("score").alias("best"), score.alias("score"), F.sum("evidence").alias("evidence"))
    ranked = groups.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), "value"))).withColumn("groups", F.count("*").over(Window.partitionBy(by)))
    rest = (F.col("groups") > most) & (F.col("rank") >= most)
    folded = ranked.groupBy(by, F.when(rest, "remainder").otherwise(F.col("value")).alias("value"), rest.alias("remainder")).agg(F.sum("members").alias("members"), F.max("best").alias("best"), F.sum("evidence").alias("evidence"))
    return folded.select(by, "value", "remainder", "members", (F.col("best") + F.log(1.0 + F.col("members")) * 0.25).alias("score"), "evidence")
