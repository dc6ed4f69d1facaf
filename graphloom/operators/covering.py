"""Which tests reach a node, as bitmaps.

Tests are numbered in blocks. A node has one bitmap for each block of which some
test reaches it; along an edge bitmaps are united, and only those that grew go on.
So a round moves at most a row for each node and block, where pairs of a test and
a node would be a row for each test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize

#: Tests of a block, on the mean; a bitmap has 32,768 places, and what passes them lies in a bitmap of its own.
BLOCK = 16_384
STEPS = "kind in ('calls', 'tests')"


def numbered(tests: DataFrame) -> DataFrame:
    """(id, block, place): blocks by hash, numbers within each; the block holds the bitmap's own number too."""
    blocks = max(1, -(-tests.count() // BLOCK))
    dealt = tests.select("id").distinct().withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    number = F.col("part") * 2**31 + rank
    return dealt.select("id", F.bitmap_bucket_number(number).alias("block"), F.bitmap_bit_position(number).alias("place"))


def _has(bitmap: str, place: str) -> Column:
    """Whether the bit at a place is set: eight places a byte, the lowest bit first."""
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (F.col(place) % 8).cast("int")) == 1


def covering_tests(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, block, bitmap) of the tests that reach each node over calls and tests, and the tests' numbers.

    A test's own bit is set where it reaches itself in a cycle; the readers below leave it out.
    """
    numbers = materialize(numbered(nodes.where("kind = 'test'")), "tests")
    steps = materialize(edges.where(STEPS).select("source", "target").distinct(), "steps")
    first = steps.join(numbers, steps["source"] == numbers["id"])
    seen = front = materialize(first.groupBy(F.col("target").alias("node"), "block").agg(F.bitmap_construct_agg("place").alias("bitmap")), "covering")
    while not front.isEmpty():
        offers = steps.join(front, steps["source"] == front["node"]).groupBy(F.col("target").alias("node"), "block").agg(F.bitmap_or_agg("bitmap").alias("offer"))
        known = seen.select("node", "block", F.col("bitmap").alias("old"))
        both = offers.join(known, ["node", "block"], "left")
        sides = both.select("node", "block", "old", F.explode(F.array_compact(F.array("old", "offer"))).alias("side"))
        united = sides.groupBy("node", "block").agg(F.bitmap_or_agg("side").alias("bitmap"), F.coalesce(F.max(F.bitmap_count("old")), F.lit(0)).alias("before"))
        front = materialize(united.where("bitmap_count(bitmap) > before").select("node", "block", "bitmap"), "covering")
        seen = materialize(seen.join(front.select("node", "block"), ["node", "block"], "left_anti").unionByName(front), "covered")
    return seen, numbers


def covering_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, tests): how many other tests reach a node that some reach."""
    seen, numbers = covering_tests(nodes, edges)
    own = numbers.select(F.col("id").alias("node"), "block", "place")
    marked = seen.join(own, ["node", "block"], "left")
    itself = F.when(F.col("place").isNotNull() & _has("bitmap", "place"), 1).otherwise(0)
    return marked.groupBy("node").agg(F.sum(F.bitmap_count("bitmap") - itself).alias("tests")).where("tests > 0")


def test_reachability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, test): tests from which a node is reached over calls and tests; a test does not cover itself."""
    seen, numbers = covering_tests(nodes, edges)
    empty = F.lit(bytes(1))
    bytes_ = F.filter(F.sequence(F.lit(1), F.lit(4096)), lambda k: F.substring(F.col("bitmap"), k, F.lit(1)) != empty)
    parts = seen.select("node", "block", "bitmap", F.explode(bytes_).alias("byte"))
    bits = parts.select("node", "block", "byte", F.conv(F.hex(F.substring(F.col("bitmap"), F.col("byte"), F.lit(1))), 16, 10).cast("int").alias("set"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    places = bits.where("getbit(`set`, bit) = 1").select("node", "block", ((F.col("byte") - 1) * 8 + F.col("bit")).cast("long").alias("place"))
    return places.join(numbers, ["block", "place"]).where("id <> node").select("node", F.col("id").alias("test"))
