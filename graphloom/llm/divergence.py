"""How far the sources of a language differ in their terms.

Terms are counted by sorting. Each task sorts the (lang, term, source, document)
of its own rows and reads them run by run: how many documents of a run, how often
in all. These partial counts are dealt by (lang, term), sorted by source and read
run by run again, which gives a term's documents in its language and its count in
each source; so a term of every document reaches its task once for each task and
source that has it, not once a document.

The differences of all pairs of sources are sums over runs too. In a run of a kept
term only the sources that have it are compared with one another; what a source's
terms differ from those that lack them follows from the values of both, without a
row for each term that is lacking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_batches, materialize, slices

#: Documents of its language that a kept term is in; what each count is raised by; the unit of shares; terms told of a group.
KEPT, ADDED, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Rows of partial counts that a task holds before it sends them on; pairs of sources likewise.
HELD = 300_000
#: Letters in small, bytes of other characters as they are, all else a space.
_TERMS = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by some keys, the first the most significant, and where a run of equal keys begins in it."""
    order = np.lexsort(keys[::-1])
    first = np.zeros(len(order), bool)
    first[:1] = True
    for key in keys:
        in_order = key[order]
        first[1:] |= in_order[1:] != in_order[:-1]
    return order, np.flatnonzero(first)


def _counted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms of all texts, with the row of each."""
    data = pc.fill_null(texts.cast(pa.large_binary()), b"")
    spans = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    joined = bytes(memoryview(data.buffers()[2] or b"")[spans[0] : spans[-1]]).translate(_TERMS)
    plain = pa.Array.from_buffers(pa.large_utf8(), len(data), [None, pa.py_buffer(spans - spans[0]), pa.py_buffer(joined)])
    split = pc.ascii_split_whitespace(plain)
    terms, owner = split.flatten(), pc.list_parent_indices(split)
    real = pc.greater(pc.binary_length(terms), 0)
    code = terms.filter(real).dictionary_encode()
    return code.dictionary, code.indices.to_numpy().astype(np.int64), owner.filter(real).to_numpy()


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, documents, times) of a task's rows, from runs of (lang, term, source, document)."""
    held, rows = [], 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "term", "source"]).aggregate([("documents", "sum"), ("times", "sum")]).rename_columns(["lang", "term", "source", "documents", "times"])

    for batch in slices(batches):
        dictionary, term, row = _counted(batch["text"])
        lang, source = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
        a, c = lang.indices.to_numpy()[row], source.indices.to_numpy()[row]
        order, first = _runs(a, term, c, row)
        times = np.diff(first, append=len(order))
        kept = order[first]
        _, run = _runs(a[kept], term[kept], c[kept])  # these are in order already
        documents, times = np.diff(run, append=len(kept)), np.add.reduceat(times, run) if len(run) else times
        kept = kept[run]
        part = [lang.dictionary.take(pa.array(a[kept])), dictionary.take(pa.array(term[kept])).cast(pa.string()), source.dictionary.take(pa.array(c[kept])), pa.array(documents, pa.int64()), pa.array(times, pa.int64())]
        held.append(pa.Table.from_arrays(part, names=["lang", "term", "source", "documents", "times"]))
        rows += len(kept)
        if rows > HELD:
            held, rows = [merged()], 0
            if held[0].num_rows > HELD // 2:
                yield from held[0].combine_chunks().to_batches(10_000)
                held = []
    if held:
        yield from merged().combine_chunks().to_batches(10_000)


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows, cut so that all rows of a (lang, term) are in one."""
    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        if not table.num_rows:
            continue
        keys = [table[n].combine_chunks().dictionary_encode().indices.to_numpy() for n in ("lang", "term")]
        last = np.logical_and.reduce([k == k[-1] for k in keys])
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        left = table.slice(cut)
        if cut:
            yield table.slice(0, cut).combine_chunks().to_batches()[0]
    if left is not None:
        yield left.combine_chunks().to_batches()[0]


def _kept(least: int):
    """From sorted partial counts, the terms that enough documents have: times in the source and in the language."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_term(_folded(batches)):
            lang, term = (batch[n].dictionary_encode().indices.to_numpy() for n in ("lang", "term"))
            first = np.concatenate([[True], (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])])
            at, run = np.flatnonzero(first), np.cumsum(first) - 1
            documents, times = (np.add.reduceat(batch[n].to_numpy(), at)[run] for n in ("documents", "times"))
            columns = [*(batch[n] for n in ("lang", "term", "source", "times")), pa.array(times), pa.array(first)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "times", "in_lang", "first"]).filter(pa.array(documents >= least))

    return scan


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted partial counts with one row for each (lang, term, source); only the row that may go on is held back."""
    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        keys = [table[n].combine_chunks().dictionary_encode().indices.to_numpy() for n in ("lang", "term", "source")]
        new = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
        sums = [pa.array(np.add.reduceat(table[n].to_numpy(), new)) for n in ("documents", "times")]
        folded = pa.Table.from_arrays([*(table[n].combine_chunks().take(pa.array(new)) for n in ("lang", "term", "source")), *sums], names=["lang", "term", "source", "documents", "times"])
        left = folded.slice(folded.num_rows - 1)
        if folded.num_rows > 1:
            yield folded.slice(0, folded.num_rows - 1).combine_chunks().to_batches()[0]
    if left is not None:
        yield left.combine_chunks().to_batches()[0]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums over runs of terms, for each two sources that share one.

    For each shared term: their distance, less the distances that each has from a source
    without the term, plus that of two sources without it.
    """
    held: dict[tuple[str, int, int], int] = {}
    names: list[str] = []
    number: dict[str, int] = {}

    def told() -> pa.RecordBatch:
        keys = list(held)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([names[k[1]] for k in keys], pa.string()), pa.array([names[k[2]] for k in keys], pa.string()), pa.array(held.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "shared"])

    for batch in _by_term(batches):
        langs, terms = batch["lang"].dictionary_encode(), batch["term"].dictionary_encode()
        lang, term = langs.indices.to_numpy(), terms.indices.to_numpy()
        code = batch["source"].dictionary_encode()
        known = np.array([number.setdefault(s, len(number)) for s in code.dictionary.to_pylist()], np.int64)
        names = list(number)
        source, p, base = known[code.indices.to_numpy()], batch["p"].to_numpy(), batch["base"].to_numpy()
        new = np.concatenate([[True], (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])]) if len(lang) else np.zeros(0, bool)
        run = np.cumsum(new)
        ahead = 1
        while ahead < len(run):  # rows of a run that are `ahead` apart, so only pairs of sources that share the term
            at = np.flatnonzero(run[ahead:] == run[:-ahead])
            if not len(at):
                break
            to = at + ahead
            shared = np.abs(p[at] - p[to]) - np.abs(p[at] - base[to]) - np.abs(p[to] - base[at]) + np.abs(base[at] - base[to])
            order, first = _runs(lang[at], source[at], source[to])
            sums = np.add.reduceat(shared[order], first)
            for a, g, o, value in zip(lang[at][order[first]].tolist(), source[at][order[first]].tolist(), source[to][order[first]].tolist(), sums.tolist()):
                key = (langs.dictionary[a].as_py(), g, o)
                held[key] = held.get(key, 0) + value
            ahead += 1
            if len(held) >= HELD:
                yield told()
                held.clear()
    if held:
        yield told()


def _share(times: str, total: str) -> Column:
    """The share of a count in parts of UNIT, exact for any long; 0 for a language without terms."""
    return F.expr(f"if(terms_kept = 0, 0L, 1 + (cast({times} + {ADDED} AS decimal(20, 0)) * {UNIT}) div cast({total} + {ADDED} * terms_kept AS decimal(20, 0)))").cast("long")


def kept_terms(docs: DataFrame, least: int = KEPT) -> DataFrame:
    """(lang, term, source, times, in_lang, first): how often a source and its language have each kept term.

    ``first`` marks one row of each (lang, term). A document is a row, also where ids repeat.
    """
    counts = "lang string, term string, source string, documents long, times long"
    partial = map_batches(docs.select("text", *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))), _partial, counts)
    ordered = partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return map_batches(ordered, _kept(least), "lang string, term string, source string, times long, in_lang long, first boolean")


def divergence(docs: DataFrame, least: int = KEPT, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: the summed differences of shares to each other source of the language;
    part ``term``: the ``top`` terms whose share in the source passes that in the language most.
    Null text, lang and source are read as ''. Sources without terms are in every pair;
    in a language without kept terms all pairs are 0. Equal values are ranked by item.
    """
    kept = materialize(kept_terms(docs, least), "kept_terms")
    counted = kept.groupBy("lang", "source").agg(F.sum("times").alias("total"), F.count("*").alias("terms"), F.count_if("first").alias("firsts"))
    occurring = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct().join(counted, ["lang", "source"], "left").na.fill(0)
    by_lang = Window.partitionBy("lang")
    groups = occurring.withColumns({"terms_kept": F.sum("firsts").over(by_lang), "lang_total": F.sum("total").over(by_lang)})
    groups = materialize(groups.withColumn("base", _share("0", "total")), "groups")

    shares = kept.join(groups, ["lang", "source"]).withColumns({"p": _share("times", "total"), "q": _share("in_lang", "lang_total")})
    ordered = shares.select("lang", "term", "source", "p", "base").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    shared = map_batches(ordered, _pairs, "lang string, source string, item string, shared long")

    # What the terms of a source differ from the base of each other source: prefix sums over both by value.
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("v"), F.col("terms").alias("other_terms"))
    lacking = (F.col("terms_kept") - F.col("terms") - F.col("other_terms")) * F.abs(F.col("base") - F.col("v"))
    probes = groups.join(other, "lang").where("source != item").select("lang", "source", "item", "v", F.lit(0).cast("long").alias("n"), F.when(F.col("source") < F.col("item"), lacking).otherwise(0).alias("lacking"))
    values = shares.groupBy("lang", "source", F.col("p").alias("v")).agg(F.count("*").alias("n"))
    both = probes.unionByName(values, allowMissingColumns=True)
    below = Window.partitionBy("lang", "source").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("lang", "source")
    nv = F.col("n") * F.col("v")
    summed = both.withColumns({"cn": F.sum("n").over(below), "cs": F.sum(nv).over(below), "tn": F.sum("n").over(whole), "ts": F.sum(nv).over(whole)}).where("item IS NOT NULL")
    alone = summed.select("lang", "source", "item", (F.expr("cn * v - cs + (ts - cs) - (tn - cn) * v") + F.col("lacking")).alias("value"))
    parts = alone.unionByName(shared.withColumnRenamed("shared", "value"))
    total = parts.groupBy("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")).agg(F.sum("value").alias("value"))
    sides = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = total.select("lang", "value", sides).withColumn("part", F.lit("pair"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("p - q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op13(docs: DataFrame) -> DataFrame:
    """The audit of all documents."""
    return divergence(docs)
