"""Connected components of an edge table by randomised contraction.

Each round every node points to the neighbour (or itself) with the least rank,
ranks being a fresh hash of the id. Paths are shortened by one pointer jump, the
edges are relabelled and loops vanish. A constant share of the nodes goes in each
round, whatever the shape of the graph; hubs only meet in partial aggregates and
in joins that adaptive execution can split. Nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, root) for each node that has an edge; equal roots, same component.

    Loops, repeated and reversed edges do no harm; edges with a null end are
    ignored; an empty table gives an empty result.
    """
    pairs = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"), F.col(src).isNotNull().alias("u"), F.col(dst).isNotNull().alias("v"))
    pairs = materialize(pairs.where("u and v and a <> b").select("a", "b").distinct(), "edges")
    maps: list[DataFrame] = []
    empty = pairs.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    turn = 0
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("b", "a"))
        rank = F.xxhash64(F.lit(turn), "a")
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "b").alias("r"), F.col("b").alias("to"))).alias("m"))
        first = materialize(least.select(F.col("a").alias("node"), F.when(F.col("m.r") < rank, F.col("m.to")).otherwise(F.col("a")).alias("to")), "point")
        hop = first.select(F.col("node").alias("mid"), F.col("to").alias("root"))
        jump = materialize(first.join(hop, F.col("to") == F.col("mid")).select("node", "root"), "jump")
        maps.append(jump)
        left = jump.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = jump.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        told = pairs.join(left, "a").join(right, "b").where("ra <> rb")
        pairs = materialize(told.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        turn += 1
    if not maps:
        return empty

    def follow(done: DataFrame, step: DataFrame) -> DataFrame:
        step = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        return done.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))

    return materialize(reduce(follow, maps), "roots")
