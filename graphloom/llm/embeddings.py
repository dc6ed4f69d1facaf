"""Near-duplicate embeddings by sorted projection passes.

In each pass the distinct vectors of a label are ordered lexicographically by
their concatenated random hashes (signs of projections of what is left without the
label's mean) and each is compared with a bounded window of its successors. The
number of passes follows the label's size and spread, so that a pair at the
threshold meets in one of them with a chance of RECALL, however large the label.
Verified pairs are united across passes. As windows see only part of a large
group, links are then counted exactly inside each component: its members are dealt
into chunks, and every pair of chunks is compared tile by tile; only counts leave
a pair of chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import map_batches, materialize

COSINE, WINDOW, HASHES, SEED = 0.98, 48, 60, 2
#: Chance that a pair at the threshold meets in some pass; least cosine without the mean that is reckoned with.
RECALL, LEAST_COSINE = 0.99, 0.5
#: Vectors of a block of windows; bytes of a chunk, which a task holds twice; chunks that a middling component is dealt into, of that many members at least; members of a tile.
BLOCK, CHUNK_BYTES, CHUNKS, CHUNK, TILE = 2048, 16 << 20, 16, 128, 1024


def _doubles(column: pa.Array) -> list[bytes | None]:
    """Usable vectors as bytes of doubles; null where one can't be compared."""
    out: list[bytes | None] = []
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
    at = 0
    for n in column.value_lengths().to_pylist():
        if n is None:
            out.append(None)
            continue
        v, at = values[at : at + n], at + n
        scale = np.abs(v).max() if n else 0.0
        out.append(v.tobytes() if n and np.isfinite(v).all() and scale > 0 else None)
    return out


def _unit(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors)).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vec): ``vec`` is null for rows that link with nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = [v if known else None for v, known in zip(_doubles(b.column(2)), b.column(1).is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vec, pa.binary())], ["vec_id", "label", "vec"])

    chosen = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    return map_batches(chosen, read, "vec_id long, label string, vec binary")


def passes(n: int, common: float) -> int:
    """Passes over a label of ``n`` vectors whose mean, of unit vectors, has the square length ``common``."""
    if n <= WINDOW:
        return 1
    cosine = max(LEAST_COSINE, (COSINE - common) / max(1e-9, 1 - common))
    same = 1 - math.acos(min(1.0, cosine)) / math.pi  # chance of an equal bit
    met = same ** math.log2(n / WINDOW)  # of as many equal bits as leave a window of vectors
    return max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - met)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and sums of unit vectors by label and size, in parts."""
    held: dict[tuple[str, int], tuple[int, np.ndarray]] = {}

    def told() -> pa.RecordBatch:
        keys, values = list(held), list(held.values())
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1].tobytes() for v in values], pa.binary())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["label", "size", "n", "total"])

    for b in batches:
        by: dict[tuple[str, int], list[bytes]] = {}
        for label, vec in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by.setdefault((label, len(vec)), []).append(vec)
        for key, vectors in by.items():
            n, total = held.get(key, (0, 0.0))
            held[key] = n + len(vectors), total + _unit(vectors).sum(0)
        if len(held) > 500:
            yield told()
    yield told()


def _means(table: pa.Table) -> pa.Table:
    n = sum(table.column("n").to_pylist())
    mean = sum(np.frombuffer(x) for x in table.column("total").to_pylist()) / n
    return pa.table([table.column("label")[:1], table.column("size")[:1], pa.array([mean.tobytes()], pa.binary()), pa.array([passes(n, float(mean @ mean))], pa.int32())], ["label", "size", "mean", "passes"])


@lru_cache(64)
def _planes(dimensions: int, p: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimensions, p]).normal(size=(dimensions, HASHES))


_WEIGHTS = 1 << np.arange(HASHES - 1, -1, -1, dtype=np.int64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each vector and pass of its label."""
    for b in batches:
        by: dict[tuple[int, bytes], list[int]] = {}
        vec, mean, times = (b.column(k).to_pylist() for k in (3, 4, 5))
        for k in range(b.num_rows):
            by.setdefault((times[k], mean[k]), []).append(k)
        for (n, middle), at in by.items():
            x = _unit([vec[k] for k in at]) - np.frombuffer(middle)
            part = b.take(pa.array(at, pa.int64()))
            for p in range(n):
                key = (x @ _planes(x.shape[1], p) > 0) @ _WEIGHTS
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), *part.columns[:3], pa.array(key), part.column(3)], ["pass", "rep", "label", "size", "key", "vec"])


def _neighbours(table: pa.Table) -> pa.Table:
    """Links that tie together what the windows of one block verify: (a, b)."""
    table = table.sort_by("rank")
    kind = list(zip(*(table.column(c).to_pylist() for c in ("pass", "label", "size")), strict=True))
    rep, vec = table.column("rep").to_pylist(), table.column("vec").to_pylist()
    links, start = [], 0
    while start < len(kind):
        stop = start + 1
        while stop < len(kind) and kind[stop] == kind[start]:
            stop += 1
        x, root = _unit(vec[start:stop]), list(range(start, stop))

        def find(k: int, root: list[int] = root, start: int = start) -> int:
            while root[k - start] != k:
                root[k - start] = root[root[k - start] - start]
                k = root[k - start]
            return k

        for o in range(1, min(WINDOW, len(x) - 1) + 1):
            for k in np.flatnonzero(np.einsum("ij,ij->i", x[:-o], x[o:]) >= COSINE).tolist():
                a, b = find(start + k), find(start + k + o)
                if a != b:
                    root[max(a, b) - start] = min(a, b)
                    links.append((rep[start + k], rep[start + k + o]))
        start = stop
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*links, strict=True) if links else ([], []))], ["a", "b"])


def window_links(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs of ``rep`` that the passes verify, one spanning set per block."""
    sums = map_batches(distinct.select("label", "vec"), _sums, "label string, size int, n long, total binary")
    means = materialize(sums.groupBy("label", "size").applyInArrow(_means, "label string, size int, mean binary, passes int"), "means")
    sized = distinct.select("rep", "label", F.octet_length("vec").alias("size"), "vec").join(means, ["label", "size"])
    hashed = map_batches(sized.select("rep", "label", "size", "vec", "mean", "passes"), _hashed, "pass int, rep long, label string, size int, key long, vec binary")
    order = ["pass", "label", "size", "key", "rep"]
    ranged = hashed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "passes")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, total = [], 0
    for r in ranged.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        before.append((r["part"], total))
        total += r["count"]
    if not total:
        return distinct.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    offsets = distinct.sparkSession.createDataFrame(before, "part long, before long")
    ranked = ranged.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + place)
    block = F.floor(F.col("rank") / BLOCK)
    halo = (F.col("rank") % BLOCK < WINDOW) & (F.col("rank") >= BLOCK)
    dealt = ranked.withColumn("block", F.explode(F.when(halo, F.array(block, block - 1)).otherwise(F.array(block))))
    return dealt.select("block", "rank", "pass", "label", "size", "rep", "vec").groupBy("block").applyInArrow(_neighbours, "a long, b long").distinct()


def _counted(table: pa.Table) -> pa.Table:
    """Links of each member within the chunk pairs of one bucket: (rep, links)."""
    groups: dict[tuple, list[int]] = {}
    columns = [table.column(c).to_pylist() for c in ("root", "i", "j", "chunk", "rep", "n", "vec")]
    for k, key in enumerate(zip(*columns[:3], strict=True)):
        groups.setdefault(key, []).append(k)
    chunk, rep, copies, vec = columns[3:]
    told: list[tuple[int, int]] = []
    for (_, i, j), rows in groups.items():
        x, n = _unit([vec[k] for k in rows]), np.array([copies[k] for k in rows])
        side = np.array([chunk[k] for k in rows])
        left, right, links = np.flatnonzero(side == i), np.flatnonzero(side == j), np.zeros(len(rows), np.int64)
        for a in range(0, len(left), TILE):
            for b in range(0, len(right), TILE):
                p, q = left[a : a + TILE], right[b : b + TILE]
                near = x[p] @ x[q].T >= COSINE
                if i == j:
                    near &= p[:, None] != q
                links[p] += near @ n[q]
                if i != j:
                    links[q] += n[p] @ near
        told += zip([rep[k] for k in rows], links.tolist(), strict=True)
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*told, strict=True) if told else ([], []))], ["rep", "links"])


def component_links(members: DataFrame) -> DataFrame:
    """(rep, links) by exact comparison within each ``root`` of (root, rep, n, vec).

    A member goes out once for each chunk of its component: CHUNKS times at
    most, until a component passes CHUNKS * CHUNK_BYTES.
    """
    total = F.count("*")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.sum(F.octet_length("vec")) / CHUNK_BYTES), F.least(F.lit(CHUNKS), F.ceil(total / CHUNK))).cast("int").alias("chunks"))
    cut = members.join(sizes, "root").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    pairs = cut.select("root", "rep", "n", "vec", "chunk", "chunks", other).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    # pairs of large components go alone, others together by the thousand of rows
    few = max(1, -(-members.count() // (8 * CHUNK)))
    bucket = F.when(F.col("chunks") > 1, F.xxhash64("root", "i", "j")).otherwise(F.pmod(F.xxhash64("root"), F.lit(few)))
    dealt = pairs.select(bucket.alias("bucket"), "root", "i", "j", "chunk", "rep", "n", "vec").groupBy("bucket")
    return dealt.applyInArrow(_counted, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``rows``.

    Only vectors of equal length and equal labels, not null, are compared.
    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing: they have 0 links and are their own component. Copies
    count as links; repeated rows link with each other and share their results.
    Other columns are not read; an empty table gives an empty result.
    """
    read = materialize(usable(rows), "vectors")
    fit = read.where("vec is not null")
    distinct = materialize(fit.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()), "distinct")
    roots = connected_components(window_links(distinct))
    members = materialize(distinct.select("rep", "n", "least", "vec").join(roots.withColumnRenamed("node", "rep"), "rep"), "members")
    links = component_links(members.select("root", "rep", "n", "vec"))
    heads = members.groupBy("root").agg(F.min("least").alias("head"))
    found = members.select("rep", "root").join(heads, "root").join(links, "rep", "left").select("rep", "head", "links")
    classed = distinct.join(found, "rep", "left").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("head", "least").alias("component_id"))
    told = fit.join(classed, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = read.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


op2 = near_vectors
