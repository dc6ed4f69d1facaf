"""Strong components by trimming and colouring, without a closure.

Nodes without an edge in or out are trimmed first, for they are in no cycle. Then
each node takes the least colour among those that lead to it; the component of a
colour's own node is what leads back to that node within the colour. Edges between
colours, and those of components found, are in no other component and go. Colours
are random numbers, so that what remains of a long row of components is cut near
its middle, as by quicksort. No table is larger than the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize

#: Rounds of trimming before each colouring; what they leave, the colouring settles.
TRIMS = 3


def _trimmed(edges: DataFrame, rounds: int = TRIMS) -> DataFrame:
    """(u, v) edges without those that begin where none ends, or end where none begins."""
    size = edges.count()
    for _ in range(rounds):
        into, out = edges.select(F.col("v").alias("u")).distinct(), edges.select(F.col("u").alias("v")).distinct()
        kept = materialize(edges.join(into, "u", "left_semi").join(out, "v", "left_semi").select("u", "v"), "trimmed")
        left = kept.count()
        edges, done = kept, left in (0, size)
        if done:
            break
        size = left
    return edges


def _coloured(edges: DataFrame, seed: int) -> DataFrame:
    """(node, colour): the least colour of what leads to a node, itself included."""
    own = F.struct(F.xxhash64(F.col("node"), F.lit(seed)).alias("draw"), F.col("node").alias("name"))
    colours = front = materialize(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", own.alias("colour")), "colours")
    while not front.isEmpty():
        offers = edges.join(front, edges["u"] == front["node"]).groupBy(F.col("v").alias("node")).agg(F.min("colour").alias("offer"))
        front = materialize(offers.join(colours, "node").where("offer < colour").select("node", F.col("offer").alias("colour")), "recoloured")
        colours = materialize(colours.join(front.select("node"), "node", "left_anti").unionByName(front), "colours")
    return colours.select("node", F.col("colour.name").alias("colour"))


def strong_components(pairs: DataFrame) -> DataFrame:
    """(node, component, size) of strongly connected components of two or more nodes; ``component`` is the least node.

    pairs: u, v. Loops, repeated and null edges have no part. The rounds follow the length
    of the longest way on which a colour spreads, not the number of pairs that are connected.
    """
    edges = materialize(pairs.where("u <> v").select("u", "v").distinct(), "edges")
    found, seed = None, 0
    while True:
        edges = _trimmed(edges)
        if edges.isEmpty():
            break
        seed += 1
        colours = materialize(_coloured(edges, seed), "coloured")
        at_u, at_v = (colours.select(F.col("node").alias(n), F.col("colour").alias(f"{n}_colour")) for n in ("u", "v"))
        inner = materialize(edges.join(at_u, "u").join(at_v, "v").where("u_colour = v_colour").select("u", "v", F.col("u_colour").alias("colour")), "inner")
        seen = front = materialize(inner.where("v = colour").select(F.col("colour").alias("node"), "colour").distinct(), "back")
        while not front.isEmpty():
            back = inner.select(F.col("u"), F.col("v").alias("node")).join(front, "node").select(F.col("u").alias("node"), "colour").distinct()
            front = materialize(back.join(seen, ["node", "colour"], "left_anti"), "back")
            seen = seen.unionByName(front)
        found = seen if found is None else found.unionByName(seen)
        nodes = seen.select("node")
        edges = materialize(inner.join(nodes, inner["u"] == nodes["node"], "left_anti").join(nodes, inner["v"] == nodes["node"], "left_anti").select("u", "v"), "edges")
    if found is None:
        return pairs.select(F.col("u").alias("node"), F.col("u").alias("component"), F.lit(0).cast("long").alias("size")).where("false")
    named = found.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    return found.join(named, "colour").select("node", "component", "size")
