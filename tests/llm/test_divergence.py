"""The audit of sources against a count of every term in every group."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa

from graphloom.llm import divergence

UNIT = 1_000_000_000


def plain(rows, least, top):
    documents, counts, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        documents.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    result = []
    for lang, sources in groups.items():
        kept = [t for (g, t), n in documents.items() if g == lang and n >= least]
        share = lambda c, n: 1 + UNIT * (c + 5) // (n + 5 * len(kept))
        total = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): share(counts[lang, s, t], total[s]) for s in sources for t in kept}
        q = {t: share(sum(counts[lang, s, t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = sorted((-sum(abs(p[s, t] - p[o, t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[s, t], t.encode()) for t in kept if counts[lang, s, t] and p[s, t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                result += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(result)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_odd_rows(spark):
    rows = [("The the THE mill", "en", "a"), ("the old mill", "en", "b"), ("Ünïx ünïx the", "en", None), (None, "en", "d"), ("", None, "a"), ("!!! 12 -", "de", "a"), ("x", "de", "b"), ("the mill_mill", "en", "a")]
    rows += [("alpha beta", "xx", s) for s in "abc"] + [("日本 alpha", "xx", "a")] * 3 + [("the " * 3000, "en", "long"), ("É é É", None, None)]
    docs = spark.createDataFrame([(k, *r, "c") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string")
    for least, top in ((1, 2), (2, 50), (3, 1), (99, 5)):
        assert rows_of(divergence.divergence(docs, least, top)) == plain(rows, least, top)
    assert rows_of(divergence.divergence(docs.where("false"))) == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    got = rows_of(divergence.op13(docs))
    assert got == plain(rows, 30, 50) and any(r[2] == "term" for r in got)


def test_runs_that_cross_batches_and_are_sent_on_early(spark, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang", "source").collect()]
    table = pa.table({n: [r[k] or "" for r in rows] for k, n in enumerate(("text", "lang", "source"))})

    def partial(held):
        monkeypatch.setattr(divergence, "HELD", held)
        found = pa.concat_tables(pa.Table.from_batches([b]) for b in divergence._partial(iter(table.to_batches(7))))
        return found.sort_by([(n, "ascending") for n in ("lang", "term", "source")])

    few, many = partial(50), partial(10**9)
    assert few.num_rows > many.num_rows
    kept = [pa.concat_tables(pa.Table.from_batches([b]) for b in divergence._kept(5)(iter(t.to_batches(size)))) for t, size in ((few, 3), (few, 10**6), (many, 11))]
    assert kept[0].to_pylist() == kept[1].to_pylist() == kept[2].to_pylist() and kept[0].num_rows > 100
    shares = kept[0].append_column("p", kept[0]["times"]).append_column("base", pa.array([1] * kept[0].num_rows, pa.int64()))

    def pairs(held, size):
        monkeypatch.setattr(divergence, "HELD", held)
        sums = Counter()
        for batch in divergence._pairs(iter(shares.to_batches(size))):
            for r in batch.to_pylist():
                sums[r["lang"], r["source"], r["item"]] += r["shared"]
        return sums

    assert pairs(2, 4) == pairs(10**9, 10**9) != {}


def test_partial_counts_are_runs():
    batch = pa.RecordBatch.from_pydict({"text": ["b a b", "b", None, "a"], "lang": ["x", "x", "x", "y"], "source": ["s", "s", "s", "s"]})
    rows = [tuple(r.values()) for b in divergence._partial(iter([batch])) for r in b.to_pylist()]
    assert sorted(rows) == [("x", "a", "s", 1, 1), ("x", "b", "s", 2, 3), ("y", "a", "s", 1, 1)]
