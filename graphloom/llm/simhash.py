"""SimHash near-duplicate detection by covering locality-sensitive hashing.

Fingerprints have 64 bits. Bit ``i`` carries a nonzero vector of three bits; for
each of the seven nonzero vectors ``v`` a mask keeps the bits whose vector has an
odd product with ``v``. Two positions span at most two dimensions of three, so
for any two differing bits some mask drops both: every pair within the radius of
two collides in a table, without exception.

Only fingerprints that meet another one in a table go on. They are verified
without forming pairs of a bucket: two fingerprints differ in at most two bits
just when some 64-bit word is at most one bit away from both. Each fingerprint
names those words within the bits that the shared mask had dropped; a word has at
most 65 namers, whatever the bucket's size, so large groups of near copies cost
linear work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .components import connected_components
from .shared import map_batches, materialize, slices

BITS, DIMENSIONS, CHUNK = 64, 3, 1 << 16
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def covering_masks() -> list[int]:
    """The seven masks, as unsigned integers."""
    vector = [1 + i % 7 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, 1 << DIMENSIONS)]


def fingerprint(text: bytes | None) -> int:
    """Fingerprint of UTF-8 bytes: null, empty and blank texts give 0."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and 0x09-0x0D with the space
    if not words:
        return 0
    size, counts, total = 3, np.zeros(BITS, np.int64), max(1, len(words) - 2)
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + size - 1]
        grams = [b" ".join(part)] if len(words) <= size else map(b" ".join, zip(part, part[1:], part[2:], strict=False))
        hashes = np.fromiter(map(_hash, grams), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def majority(hashes: np.ndarray) -> int:
    """Fingerprint of a set of hashes: the bits that over half of them have; 0 for none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        values = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long): one row per row of ``docs``; other columns are not read."""
    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return map_batches(kept, _fingerprints, "doc_id long, fp long")


def _signed(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value)


def near_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links whose closure holds all pairs of ``fp`` at two or fewer bits.

    ``distinct`` has each fingerprint once. Pairs of a dense group are not all
    listed; each word's namers are tied to the least of them.
    """
    tables = [F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(_signed(m)).alias("kept")) for t, m in enumerate(covering_masks())]
    rows = distinct.select("fp", F.explode(F.array(*tables)).alias("x")).select("fp", "x.t", "x.kept")
    met = rows.groupBy("t", "kept").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    met = materialize(met, "buckets")
    few = met.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")
    free = F.element_at(F.array(*[_signed(~m & (1 << 64) - 1) for m in covering_masks()]), F.col("t").cast("int") + 1)
    dense = rows.join(met.where("n > 2").select("t", "kept"), ["t", "kept"], "left_semi")
    dense = dense.groupBy("fp").agg(F.bit_or(free).alias("free"))
    flips = F.array(*[_signed(1 << i) for i in range(BITS)])
    near = F.transform(F.filter(flips, lambda one: one.bitwiseAND(F.col("free")) != 0), lambda one: F.col("fp").bitwiseXOR(one))
    words = dense.select("fp", F.explode(F.concat(F.array("fp"), near)).alias("word"))
    named = words.groupBy("word").agg(F.collect_list("fp").alias("by")).where(F.size("by") > 1)
    stars = named.select(F.array_min("by").alias("a"), F.explode("by").alias("b")).where("a <> b")
    return few.union(stars).distinct()


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, root): near-duplicate classes of whole texts.

    Null, empty and blank texts have fingerprint zero and link like others.
    Repeated rows keep their rows and share a class. component_id is the least
    doc_id reachable, null where no member has one; ``root`` names a class in
    any case. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(near_links(distinct.select("fp")))
    classed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(classed.join(least, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = simhash_groups, key: Callable[[bytes | None], int] = fingerprint) -> DataFrame:
    """Rows of ``docs``, unchanged: one of each near-duplicate class, that with the least doc_id.

    ``grouped`` tells the classes, ``key`` a text's fingerprint there. Rows are
    found again by doc_id and fingerprint, so that unlike texts that share a
    doc_id stay apart. A class without any doc_id keeps one of its rows; of rows
    that repeat both doc_id and fingerprint the one of least hash stays. Columns
    may have any names; an empty table stays empty.
    """
    at = len(docs.columns)
    inner = [f"c{k}" for k in range(at)]  # so that no name of the caller's meets one of these
    plain = docs.toDF(*inner)
    place = {name: k for k, name in reversed(list(enumerate(docs.columns)))}
    own, text = F.col(inner[place["doc_id"]]).cast("long"), F.col(inner[place["text"]])

    groups = grouped(docs.select("doc_id", "text"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "fp")
    first = groups.groupBy("root").agg(F.min(rank).alias("first"))
    heads = groups.select("root", rank.alias("row")).groupBy("root", "row").agg(F.count("*").alias("times"))
    chosen = first.select("root", F.col("first").alias("row")).join(heads, ["root", "row"]).select("row.*", "times")
    chosen = materialize(chosen, "chosen")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.fromiter(map(key, batch.column(at).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(values.view(np.int64)), *batch.columns[at + 1 :]], [*inner, "fp", "none", "id"])

    schema = StructType([*plain.schema.fields, StructField("fp", LongType()), StructField("none", BooleanType()), StructField("id", LongType())])
    marked = map_batches(plain.select(*inner, text.cast("binary").alias("fp"), own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("id")), add, schema)
    keys = ["none", "id", "fp"]
    single = marked.join(chosen.where("times = 1").select(keys), keys, "left_semi").select(inner)
    comparable = [c for c, field in zip(inner, docs.schema.fields, strict=True) if "map<" not in field.dataType.simpleString() and field.dataType.simpleString() != "variant"]
    repeated = marked.join(chosen.where("times > 1").select(keys), keys, "left_semi")
    repeated = repeated.groupBy(keys).agg(F.min_by(F.struct(*inner), F.xxhash64(*comparable)).alias("row")).select("row.*")
    return single.union(repeated).toDF(*docs.columns)


def op1(docs: DataFrame) -> DataFrame:
    found = simhash_groups(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
