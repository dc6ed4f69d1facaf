"""Near-duplicate texts by exact Jaccard similarity of five-word shingles.

The SimHash operator (``simhash.near_links``, over fingerprints of these shingles) finds
the first pairs; as 64 bits can't tell all pairs of such a similarity, an exact join finds
the rest, and each pair of either is verified by its texts.

Two sets of n and m shingles whose similarity is 0.8 or more share at least
ceil(0.8 n) of them, so in any one order of all shingles their first
n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1 have a shingle in common. Only these
are dealt out, and every such pair meets in a bucket, without exception. The
order puts shingles last that are frequent in a sample, as common lines and
passages are; the sample decides the work, never the result.

Buckets are runs of one sort of (shingle, text); the few shingles that a large share
of the sample holds are salted, each salt being a run, and the hubs of the runs
are members of one another's bucket. The members of a run are first compared with
its hub, the first one, and the pairs found are tied into components. A bucket that
still holds many components is one of texts that share a passage the sample missed:
their shingles are then sampled, put last, too, and the texts dealt out anew. Pairs
of the others across the few components of a bucket follow at the end, within the task that
reads the bucket; only pairs that may be similar become rows. So common
passages cost linear work and no pair goes untested; near copies that are not near their hub
still make pairs with the square of their group. Sketches of parities, a bit or more
for each shingle, tell a least number of shingles that only one of two texts
holds; pairs that differ in too many are dropped before their texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import connected_components
from .shared import map_batches, materialize, slices

WORDS, SAMPLE, SHARE, OFTEN, FREQUENT, HOT = 5, 10_000, 0.02, 3, 1 << 17, 0.005
#: Components of a bucket above which its texts are dealt out anew, and how often that is done; what is left then is compared pair by pair.
CROWD, ROUNDS = 12, 3
#: Texts of a chunk that is compared with others in blocks.
CHUNK = 512
#: Bits of a table that keeps most rows without a partner from an exchange; and the least bits of a sketch.
MARKS, SKETCH = 1 << 23, 128
_hash = partial(xxhash.xxh64_intdigest, seed=42)
_FACTORS = np.random.default_rng(5).integers(1 << 62, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def identity(text: bytes | None) -> int:
    """Hash of the words in their order; null, empty and blank texts share one."""
    return _hash(b" ".join((text or b"").lower().split()))


class _Hashes(dict):
    """Hashes of words, some remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        self[word] = found = _hash(word)
        return found


_word_hash = _Hashes().__getitem__


class Frequent:
    """Frequent shingles with their places in the order, the most frequent last; the first ``hot`` are in a large share of the texts."""

    def __init__(self, shingles: np.ndarray, hot: int):
        order = np.argsort(shingles)
        self.shingles, self.first = shingles, hot
        self.sorted, self.place, self.hot = shingles[order], len(shingles) - order, len(shingles) - hot

    def places(self, shingles: np.ndarray) -> np.ndarray:
        """0 for a shingle that isn't frequent."""
        if not len(self.sorted):
            return np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, shingles), len(self.sorted) - 1)
        return np.where(self.sorted[at] == shingles, self.place[at], 0)

    def extended(self, more: np.ndarray) -> Frequent:
        """With more shingles, less frequent than these, FREQUENT in all."""
        new = more[self.places(more) == 0] if len(more) else more
        return Frequent(np.concatenate([self.shingles, new])[:FREQUENT], self.first)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the shingles; a text of fewer words is one shingle, one of none has none."""
    words = (text or b"").lower().split()
    if len(words) < WORDS:
        return np.array([_hash(b" ".join(words))] if words else [], np.uint64)
    hashes, n = np.fromiter(map(_word_hash, words), np.uint64, len(words)), len(words) - WORDS + 1
    mixed = sum((hashes[k : k + n] * _FACTORS[k] for k in range(1, WORDS)), hashes[:n] * _FACTORS[0])
    return np.unique((mixed ^ (mixed >> np.uint64(31))) * _FACTORS[0])


def prefix(shingles: np.ndarray, frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of which any similar set holds one, and which of them are hot."""
    n = len(shingles)
    if not n:
        return shingles, np.zeros(0, bool)
    place, size = frequent.places(shingles), n + (-4 * n // 5) + 1
    rare = np.flatnonzero(place == 0)[:size]
    often = np.argsort(place, kind="stable")[len(rare) : size] if len(rare) < size else rare[:0]
    first = np.concatenate([rare, often])
    return shingles[first], place[first] > frequent.hot


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities by the low bits of the hashes, in a power of two of bits, one for each shingle at least.

    Two sets differ in at least as many shingles as their sketches, folded to one length, in bits.
    """
    size = max(SKETCH, 1 << max(0, len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def similarity_at_least(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * common >= 4 * (len(a) + len(b))


def frequent_shingles(texts: DataFrame, least: float = SHARE, wanted: np.ndarray | None = None, total: int | None = None) -> Frequent:
    """At most FREQUENT shingles that OFTEN or more texts of a sample hold; hot are those in a share of HOT.

    The sample has SAMPLE texts, or the share ``least`` if that is more. With
    ``wanted`` (see ``_marks``) it is drawn from the ``total`` texts marked there.
    """
    total = texts.count() if total is None else total
    share = min(1.0, max(least, SAMPLE / max(1, total)))
    limit = int(share * (1 << 32))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            rows = batch.column(0).to_pylist()
            if wanted is not None:
                values = np.fromiter(map(identity, rows), np.uint64, len(rows))
                drawn = _marked(values.view(np.int64), wanted) & ((values >> np.uint64(32)) < limit)
                rows = [rows[k] for k in np.flatnonzero(drawn) if values[k] not in seen and not seen.add(values[k])]
            held = [shingle_set(t) for t in rows]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*held, np.array([], np.uint64)]).view(np.int64))], ["s"])

    drawn = texts.sample(share, seed=1) if wanted is None else texts
    counts = map_batches(drawn, sets, "s long").groupBy("s").count().where(F.col("count") >= OFTEN)
    rows = counts.orderBy(F.desc("count"), "s").limit(FREQUENT).toArrow()
    hot = int((rows.column("count").to_numpy() >= HOT * share * total).sum())
    return Frequent(rows.column("s").to_numpy().view(np.uint64), hot)


def _marks(keys: DataFrame) -> np.ndarray:
    """A table of MARKS bits, those set that a ``key`` (a hash) ends in."""
    at = F.col("key").bitwiseAND(MARKS - 1)
    words = keys.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most MARKS / 64 rows
    out = np.zeros(MARKS // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def _marked(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = keys & (MARKS - 1)
    return (marks[at >> 6] >> (at & 63)) & 1 == 1


def _sifted(rows: DataFrame, key: Column, marks: np.ndarray) -> DataFrame:
    """Rows whose key may be among the marked ones."""
    names = [*rows.columns, "key"]

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(batch.column(len(names) - 1).to_numpy(), marks)))

    keyed = rows.withColumn("key", key)
    return map_batches(keyed, sift, keyed.schema).drop("key")


def _members(texts: DataFrame, frequent: Frequent) -> DataFrame:
    """(s, hub, fp, salted): a row for each text of a bucket of two or more.

    ``hub`` is the first text of the bucket, or of its part with one salt.
    """
    salts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of a partition: its copies go out once
        for batch in slices(batches):
            held, owners, parts = [np.array([], np.uint64)], [np.array([], np.uint64)], [np.array([], np.int32)]
            for text in batch.column(0).to_pylist():
                fp = identity(text)
                if fp not in seen:
                    seen.add(fp)
                    first, hot = prefix(shingle_set(text), frequent)
                    held.append(first)
                    owners.append(np.full(len(first), fp, np.uint64))
                    parts.append(np.where(hot, 1 + fp % salts, 0).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x).view(np.int64)) for x in (held, owners)), pa.array(np.concatenate(parts))], ["s", "fp", "salt"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(s, hub, fp, salt) -> pa.RecordBatch:  # noqa: ANN001
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (s, hub, fp)), pa.array(np.asarray(salt) > 0)], ["s", "hub", "fp", "salted"])

        last = None  # of the run so far: shingle, salt, hub, last text and whether the hub was told
        for batch in batches:
            s, fp, salt = (batch.column(k).to_numpy() for k in range(3))
            if last is not None:
                same = np.concatenate([[(s[0], salt[0], fp[0]) == (last[0], last[1], last[3])], (s[1:] == s[:-1]) & (fp[1:] == fp[:-1])]) if len(s) else np.zeros(0, bool)
            else:
                same = np.concatenate([[False], (s[1:] == s[:-1]) & (fp[1:] == fp[:-1])]) if len(s) else np.zeros(0, bool)
            s, fp, salt = s[~same], fp[~same], salt[~same]
            if not len(s):
                continue
            new = True if last is None else bool(s[0] != last[0] or salt[0] != last[1])
            starts = np.concatenate([[new], (s[1:] != s[:-1]) | (salt[1:] != salt[:-1])])
            run = np.cumsum(starts)  # 0: the run that was begun before
            hub = np.concatenate([[0 if last is None else last[2]], fp[starts]])[run]
            sizes = np.bincount(run, minlength=run[-1] + 1)
            if sizes[0] and not last[4]:
                yield told([last[0]], [last[2]], [last[2]], [last[1]])
            keep = (sizes > 1)[run] | (run == 0) | (salt > 0)  # of a salted shingle any part may be a bucket's
            yield told(s[keep], hub[keep], fp[keep], salt[keep])
            last = (s[-1], salt[-1], hub[-1], fp[-1], bool(keep[-1]))

    rows = map_batches(texts.select("text"), emit, "s long, fp long, salt int")
    return map_batches(rows.repartition("s", "salt").sortWithinPartitions("s", "salt", "fp"), meet, "s long, hub long, fp long, salted boolean")


def _may_be_similar() -> Column:
    """Whether sizes (na, nb) and sketches (ka, kb) leave a similarity of 0.8 possible."""
    na, nb = F.col("na"), F.col("nb")

    def folded(k: str, size: Column) -> Column:
        half = F.size(k) > size
        return F.when(half, F.zip_with(F.slice(k, 1, size), F.slice(k, size + 1, size), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(k))

    # sizes are told first: of those that pass, one sketch is at most twice as long as the other
    size = F.least(F.size("ka"), F.size("kb"))
    differ = F.aggregate(F.zip_with(folded("ka", size), folded("kb", size), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return F.when((5 * na >= 4 * nb) & (5 * nb >= 4 * na), 9 * differ <= na + nb).otherwise(False)


def _sized(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``pairs`` of texts (a, b) with their sizes and sketches."""
    for c in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("k").alias(f"k{c}")), c)
    return pairs


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those (a, b) of ``pairs``, each once, whose texts have a similarity of 0.8 or more."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "wanted")
    marks = _marks(wanted.select(F.col("fp").alias("key")))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            values = np.fromiter(map(identity, batch.column(0).to_pylist()), np.uint64, batch.num_rows).view(np.int64)
            at = [k for k in np.flatnonzero(_marked(values, marks)).tolist() if values[k] not in seen and not seen.add(values[k])]
            yield pa.RecordBatch.from_arrays([pa.array(values[at]), batch.column(0).take(pa.array(at, pa.int64()))], ["fp", "text"])

    chosen = map_batches(texts.select("text"), choose, "fp long, text binary").join(wanted, "fp", "left_semi")
    chosen = materialize(chosen.dropDuplicates(["fp"]), "chosen")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, np.ndarray] = {}

        def held(fp: int, text: bytes) -> np.ndarray:
            if fp not in near:
                if len(near) >= 8:
                    near.pop(next(iter(near)))
                near[fp] = shingle_set(text)
            return near[fp]

        for batch in slices(batches, 64):
            a, b, ta, tb = (batch.column(k).to_pylist() for k in range(4))
            kept = [similarity_at_least(held(x, p), held(y, q)) for x, y, p, q in zip(a, b, ta, tb, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    left, right = (chosen.select(F.col("fp").alias(c), F.col("text").alias(f"t{c}")) for c in ("a", "b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return materialize(map_batches(joined, compare, "a long, b long"), "similar")


def _compared(table: pa.Table) -> pa.Table:
    """(a, b): guests and hosts of each block, of different components, whose sizes and sketches leave a similarity of 0.8 possible."""
    columns = {c: table.column(c).to_numpy() for c in ("s", "i", "j", "host", "guest", "fp", "root", "n")}
    lists = table.column("k").combine_chunks()
    flat, starts = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    words = np.diff(starts)
    order = np.lexsort((columns["j"], columns["i"], columns["s"]))
    s, i, j, host, guest, fp, root, n = (x[order] for x in columns.values())
    starts, words = starts[:-1][order], words[order]
    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(s) else np.zeros(0, np.int64)
    ends = np.append(first, len(s))
    out: list[np.ndarray] = []
    for rows in (np.arange(x, y) for x, y in zip(ends[:-1], ends[1:], strict=True)):
        ours, theirs = rows[guest[rows]], rows[host[rows]]
        g, h = (x.ravel() for x in np.meshgrid(ours, theirs, indexing="ij"))
        fit = (root[g] != root[h]) & (5 * n[g] >= 4 * n[h]) & (5 * n[h] >= 4 * n[g])
        g, h = g[fit], h[fit]
        for one, two in {*zip(words[g].tolist(), words[h].tolist(), strict=True)}:
            if max(one, two) > 2 * min(one, two):
                continue
            least, at = min(one, two), np.flatnonzero((words[g] == one) & (words[h] == two))
            for part in np.array_split(at, 1 + len(at) * max(one, two) // (1 << 21)):
                x, y = (flat[starts[side[part], None] + np.arange(size)] for side, size in ((g, one), (h, two)))
                x, y = (z if size == least else z[:, :least] ^ z[:, least:] for z, size in ((x, one), (y, two)))
                near = part[9 * np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= n[g[part]] + n[h[part]]]
                out.append(np.sort(np.stack([fp[g[near]], fp[h[near]]], 1), axis=1))
    pairs = np.unique(np.concatenate([*out, np.zeros((0, 2), np.int64)]), axis=0)
    return pa.table([pa.array(pairs[:, c]) for c in (0, 1)], ["a", "b"])


def _across(told: DataFrame, several: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b): pairs of texts of different components that meet in a bucket (s, fp, root) and may be similar.

    A bucket's largest component, ``big``, is host only; the others are guests, too. A bucket is compared within one
    task, block by block if it is large: only what may be similar leaves a block, so no table of pairs is made.
    """
    at = lambda size: F.pmod(F.xxhash64("fp"), size).cast("int")
    one = lambda i, j, host, guest: F.struct(i.alias("i"), j.alias("j"), host.alias("host"), guest.alias("guest"))
    yes, no, zero, other = F.lit(True), F.lit(False), F.lit(0), F.col("root") != F.col("big")
    nh, ng = (F.ceil(F.col(c) / CHUNK).cast("int") for c in ("m", "q"))
    hosts = F.transform(F.sequence(zero, ng - 1), lambda j: one(at(nh), j, yes, no))
    guests = F.transform(F.sequence(zero, nh - 1), lambda i: one(i, at(ng), no, yes))
    cells = F.when(F.col("m") <= CHUNK, F.array(one(zero, zero, yes, other))).otherwise(F.concat(hosts, F.when(other, guests).otherwise(F.slice(guests, 1, 0))))
    rows = told.join(several, "s").join(sizes.select("fp", "k"), "fp")
    # blocks of a large bucket go alone, small buckets together by the thousand of rows
    total = max(1, -(-(several.agg(F.sum("m")).first()[0] or 0) // (4 * CHUNK)))
    rows = rows.select("s", F.explode(cells).alias("x"), "fp", "root", "n", "k", "m").select("s", "x.*", "fp", "root", "n", "k", "m")
    bucket = F.when(F.col("m") > CHUNK, F.xxhash64("s", "i", "j")).otherwise(F.pmod(F.xxhash64("s"), F.lit(total)))
    return rows.withColumn("bucket", bucket).drop("m").groupBy("bucket").applyInArrow(_compared, "a long, b long").distinct()


def _near_prints(distinct: DataFrame) -> DataFrame:
    """(a, b): texts (fp, bits) that the SimHash operator links: those of one fingerprint to the first of them, the first ones by the operator's links."""
    first = materialize(distinct.groupBy("bits").agg(F.min("fp").alias("a"), F.count("*").alias("m")), "first")
    same = distinct.join(first.where("m > 1").select("bits", "a"), "bits").select("a", F.col("fp").alias("b"))
    links = simhash.near_links(first.select(F.col("bits").alias("fp")))
    for c in ("a", "b"):
        links = links.withColumnRenamed(c, "bits").join(first.select("bits", F.col("a").alias("to")), "bits").drop("bits").withColumnRenamed("to", c)
    both = same.union(links.select("a", "b")).where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingle_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, root): classes that the pairs of similarity 0.8 or more tie together.

    Null, empty and blank texts are one class. Repeated rows keep their rows and
    share a class. component_id is the least doc_id of the class, null where no
    member has one. Other columns are not read. An empty table gives an empty
    result.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = batch.column(1).to_pylist()
            sets = [shingle_set(t) for t in rows]
            values = np.fromiter(map(identity, rows), np.uint64, len(rows))
            bits = np.array(list(map(simhash.majority, sets)), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(sketch, sets)), pa.list_(pa.int64())), pa.array(bits.view(np.int64))], ["doc_id", "fp", "n", "k", "bits"])

    prints = materialize(map_batches(texts, measure, "doc_id long, fp long, n int, k array<long>, bits long"), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("bits").alias("bits")), "distinct")
    near = materialize(_near_prints(distinct), "near")
    frequent, links, turn = frequent_shingles(texts.select("text")), None, 0
    while True:
        turn += 1
        members = materialize(_members(texts, frequent), "members")
        met = materialize(members.select("fp").distinct(), "met")
        sizes = materialize(prints.select("fp", "n", "k").join(met, "fp", "left_semi").dropDuplicates(["fp"]), "sizes")
        heads = members.where("salted").select("s", "hub").distinct()
        spans = heads.join(heads.groupBy("s").agg(F.min("hub").alias("a")), "s").select("a", F.col("hub").alias("b"))
        stars = members.select(F.col("hub").alias("a"), F.col("fp").alias("b")).union(spans).where("a <> b")
        stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        stars = materialize((stars.union(near) if links is None else stars).distinct(), "stars")
        new = stars if links is None else stars.join(links, ["a", "b"], "left_anti")
        likely = materialize(_sized(new, sizes).where(_may_be_similar()).select("a", "b"), "likely")
        links = _similar(likely, texts) if links is None else materialize(links.union(_similar(likely, texts)), "links")

        # the other pairs of buckets with a star that isn't a link, across their components; hubs have met all of their run
        failed = _marks(stars.join(links, ["a", "b"], "left_anti").select(F.col("a").bitwiseXOR(F.col("b")).alias("key")))
        untold = _sifted(members.where("hub <> fp and not salted").select("s", "hub", "fp"), F.col("hub").bitwiseXOR(F.col("fp")), failed).select("s")
        untold = materialize(untold.union(members.where("salted").select("s")).distinct(), "untold")
        others = members.where("hub <> fp or salted").select("s", "fp")
        open_ = _sifted(others, F.col("s"), _marks(untold.select(F.col("s").alias("key")))).join(untold, "s", "left_semi")
        roots = connected_components(links).withColumnRenamed("node", "fp")
        told = open_.join(roots, "fp", "left").select("s", "fp", F.coalesce("root", "fp").alias("root")).join(sizes.select("fp", "n"), "fp")
        told = materialize(told.distinct(), "open")
        parts = told.groupBy("s", "root").agg(F.count("*").alias("c")).groupBy("s").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("c", "root")).alias("big"), F.sum("c").alias("m"), (F.sum("c") - F.max("c")).alias("q"))
        several = materialize(parts.where("parts > 1"), "several")
        crowded = several.where(F.col("parts") > CROWD).select("s")
        if turn == ROUNDS or crowded.isEmpty():
            break
        crowd = materialize(told.join(crowded, "s", "left_semi").select("fp").distinct(), "crowd")
        more = frequent_shingles(texts.select("text"), 0.0, _marks(crowd.select(F.col("fp").alias("key"))), crowd.count())
        extended = frequent.extended(more.shingles)
        if len(extended.shingles) == len(frequent.shingles):
            break
        frequent = extended

    rest = _across(told, several, sizes).join(stars, ["a", "b"], "left_anti")
    links = links.union(_similar(materialize(rest, "rest"), texts))

    roots = connected_components(links)
    classed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.select("doc_id", "fp").join(classed.join(least, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "fp", "component_id", "root")
