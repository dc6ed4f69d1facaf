"""Differences of snapshots and of contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Compatibility in rising order.
RANKS = ["safe", "conditional", "potential", "break"]


def diff(base: DataFrame, head: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, before, after): added, removed and modified rows by null-safe comparison of ``fields``."""
    packed = lambda df, name: df.select(key, F.struct(*fields).alias(name))
    return compared(packed(base, "before").join(packed(head, "after"), key, "full_outer"), key)


def compared(both: DataFrame, key: str) -> DataFrame:
    """``diff`` of rows (key, before, after) that hold both sides."""
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    return both.withColumn("status", status).where("status is not null").select(key, "status", "before", "after")


def node_reasons() -> Column:
    """Kinds of change of a modified node, joined by commas."""
    differ = lambda *names: F.greatest(*[~F.col(f"before.{n}").eqNullSafe(F.col(f"after.{n}")) for n in names], F.lit(False))
    kinds = F.array_compact(F.array(F.when(differ("kind", "label", "file"), "field-changed"), F.when(differ("pkg"), "ownership-changed"), F.when(differ("exported", "cyclomatic", "loc"), "metadata-changed")))
    return F.when(F.col("status") == "added", "entity-added").when(F.col("status") == "removed", "entity-removed").when(F.size(kinds) == 0, "implementation-changed").otherwise(F.array_join(F.array_sort(kinds), ","))


def edge_reasons() -> Column:
    differ = lambda *names: F.greatest(*[~F.col(f"before.{n}").eqNullSafe(F.col(f"after.{n}")) for n in names], F.lit(False))
    kinds = F.array_compact(F.array(F.when(differ("label", "boundary", "sync"), "relationship-changed"), F.when(differ("observations"), "evidence-changed")))
    return F.when(F.col("status") == "added", "dependency-added").when(F.col("status") == "removed", "dependency-removed").otherwise(F.array_join(F.array_sort(kinds), ","))


def changed_ids(base: DataFrame, head: DataFrame, key: str, fields: list[str], both: bool = True) -> DataFrame:
    """(id): keys whose ``fields`` differ between the sides; with ``both`` only those that are on both."""
    rows = diff(base, head, key, fields)
    return (rows.where("status = 'modified'") if both else rows).select(F.col(key).alias("id"))


def analysis_reasons(base: dict[str, DataFrame], head: dict[str, DataFrame], contract_nodes: DataFrame) -> DataFrame:
    """(id, reason) that the analyses of two snapshots give, for ``with_reasons``.

    Tables by name: violations (id, node), telemetry (node_id, body), complexity
    (node_id, body), coverage (node_id, body), a body being all that is compared,
    and contracts (contract, path, value); contract_nodes: contract, node.
    """
    told = lambda rows, reason: rows.select("id", F.lit(reason).alias("reason"))
    fresh = head["violations"].join(base["violations"].select("id"), "id", "left_anti").select(F.col("node").alias("id"))
    solved = base["violations"].join(head["violations"].select("id"), "id", "left_anti").select(F.col("node").alias("id"))
    contracts = contract_changes(base["contracts"], head["contracts"]).join(contract_nodes, "contract").select(F.col("node").alias("id"))
    compared = lambda name, both: changed_ids(base[name], head[name], "node_id", ["body"], both)
    out = told(fresh, "architecture-violation").union(told(solved, "architecture-violation-resolved")).union(told(contracts, "contract-changed"))
    out = out.union(told(compared("telemetry", False), "runtime-changed")).union(told(compared("complexity", True), "complexity-changed"))
    return out.union(told(compared("coverage", True), "test-protection-changed")).where("id is not null").distinct()


def with_reasons(delta: DataFrame, reasons: DataFrame, known: DataFrame) -> DataFrame:
    """Node deltas with the reasons (id, reason) of analyses; known nodes without a delta become modified."""
    told = reasons.join(known.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("reason")).alias("more"))
    rows = delta.join(told, "id", "full_outer")
    return rows.select("id", F.coalesce("status", F.lit("modified")).alias("status"), F.array_join(F.array_sort(F.array_compact(F.concat(F.array("reasons"), F.coalesce("more", F.array().cast("array<string>"))))), ",").alias("reasons"))


def summary(node_delta: DataFrame, edge_delta: DataFrame) -> DataFrame:
    """One row: added, removed and modified nodes and edges."""
    rows = node_delta.select(F.lit("nodes").alias("what"), "status").union(edge_delta.select(F.lit("edges").alias("what"), "status"))
    return rows.agg(*[F.count_if((F.col("what") == w) & (F.col("status") == s)).alias(f"{s}_{w}") for w in ("nodes", "edges") for s in ("added", "removed", "modified")])


def changed_nodes(node_delta: DataFrame, edge_delta: DataFrame) -> DataFrame:
    """(id): nodes of the delta and the ends of its edges."""
    ends = edge_delta.select(F.split("id", r"\|").alias("e")).select(F.explode(F.array(F.col("e")[0], F.col("e")[2])).alias("id"))
    return node_delta.select("id").union(ends).distinct()


def visible_nodes(changed: DataFrame, base_edges: DataFrame, head_edges: DataFrame) -> DataFrame:
    """(id): changed nodes and their neighbours on either side."""
    return visible_by(changed, base_edges.select("source", "target").union(head_edges.select("source", "target")))


def visible_by(changed: DataFrame, ends: DataFrame) -> DataFrame:
    """(id): changed nodes and their neighbours by (source, target) of either side, which may repeat."""
    out = ends.join(changed.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    into = ends.join(changed.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
    return changed.select("id").union(out).union(into).distinct()


def field_compatibility(path: Column, kind: Column) -> Column:
    """What a changed contract field may do to its users."""
    words = F.greatest(*[path.contains(x) for x in ("/description", "/summary", "/example", "/title")])
    added = F.when(path.contains("/required/"), "break").when(path.contains("/enum/"), "potential").otherwise("safe")
    removed = F.when(words, "safe").otherwise("break")
    changed = F.when(words, "safe").when(path.contains("/type") | path.contains("/required") | path.contains("/enum/"), "break").otherwise("potential")
    return F.when(kind == "added", added).when(kind == "removed", removed).otherwise(changed)


def contract_fields(base: DataFrame, head: DataFrame) -> DataFrame:
    """(contract, path, kind, before, after, compat) of contracts on both sides, from (contract, path, value)."""
    both = base.select("contract").distinct().join(head.select("contract").distinct(), "contract", "left_semi")
    left = base.join(both, "contract", "left_semi").select("contract", "path", F.col("value").alias("before"))
    right = head.join(both, "contract", "left_semi").select("contract", "path", F.col("value").alias("after"))
    rows = left.join(right, ["contract", "path"], "full_outer").where("not (before <=> after)")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return rows.withColumn("kind", kind).select("contract", "path", "kind", "before", "after", field_compatibility(F.col("path"), F.col("kind")).alias("compat"))


def contract_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(contract, status, compatibility, fields): the worst of the fields; added contracts are safe, removed ones break."""
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col("compat"))
    worst = contract_fields(base, head).groupBy("contract").agg(F.max(rank).alias("rank"), F.count("*").alias("fields"))
    modified = worst.select("contract", F.lit("modified").alias("status"), F.element_at(F.array(*map(F.lit, RANKS)), F.col("rank").cast("int")).alias("compatibility"), "fields")
    old, new = base.select("contract").distinct(), head.select("contract").distinct()
    alone = lambda rows, status, compat: rows.select("contract", F.lit(status).alias("status"), F.lit(compat).alias("compatibility"), F.lit(0).cast("long").alias("fields"))
    return modified.union(alone(new.join(old, "contract", "left_anti"), "added", "safe")).union(alone(old.join(new, "contract", "left_anti"), "removed", "break"))
