"""Near duplicates by shingles against all pairs by brute force."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from graphloom.llm import shingles

SF = "/root/testdata/sf0.01"


def _grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def _least(rows):
    """The least doc_id of each class, by comparison of all pairs."""
    sets, root = {d: _grams(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {d: find(d) for d in ids}


def test_the_stage_drops_near_copies_of_five_word_similarity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = _least([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert got == sorted(set(want.values()))
    texts = {r.doc_id: " ".join((r.text or "").lower().split()) for r in docs.collect()}
    assert len(got) < len(set(texts.values()))  # more than exact copies


def test_chains_and_short_texts_are_whole(spark):
    base = [f"w{k}" for k in range(120)]
    rows, words = [(0, " ".join(base))], list(base)
    for k in range(1, 25):  # each near the one before, the ends far apart
        words[5 * k - 3] = f"x{k}"
        rows.append((k, " ".join(words)))
    star = [(100 + k // 7, " ".join([*base[:k], "new", *base[k + 1 :]]).replace("w", "v")) for k in range(0, 120, 7)]
    short = [(200, "one two"), (201, "One  two"), (202, "one two three"), (203, None), (204, " ")]
    rows += star + short
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.shingle_groups(docs).collect()}
    want = _least([(d, t) for d, t in rows if d < 203]) | {203: 203, 204: 203}
    assert got == want and want[24] == 0 and want[117] == 100
    assert shingles.shingle_groups(docs.limit(0)).count() == 0


def test_crowded_buckets_are_dealt_out_anew(spark, monkeypatch):
    """Texts that share a passage which the first sample misses, near pairs among them."""
    monkeypatch.setattr(shingles, "OFTEN", 1 << 30)
    rounds = []
    dealt = shingles._members

    def counted(texts, frequent):
        monkeypatch.setattr(shingles, "OFTEN", 3)  # the targeted samples
        rounds.append(dealt(texts, frequent))
        return rounds[-1]

    monkeypatch.setattr(shingles, "_members", counted)
    passage = [f"p{k}" for k in range(70)]
    rows = []
    for k in range(60):
        own = [f"t{k // 2 if k < 20 else k}w{i}" for i in range(90)]
        if k < 20 and k % 2:
            own[40] = "other"  # near its neighbour
        rows.append((k, " ".join(own[:30] + passage + own[30:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.shingle_groups(docs).collect()}
    assert got == _least(rows) and got[1] == 0 and got[59] == 59
    assert len(rounds) > 1
    sizes = [r.groupBy("s").count().agg({"count": "max"}).collect()[0][0] or 0 for r in (rounds[0], rounds[-1])]
    assert sizes[0] >= 50 and sizes[1] <= 4


def test_buckets_are_compared_in_their_tasks(spark):
    """Many components, one of them large, share a hot line: no join makes pairs of components, all blocks are compared, near pairs are found."""
    rows = [(k, " ".join([*(f"c{i}" for i in range(60)), f"x{k}"])) for k in range(900)]  # one large component
    for k in range(900, 1500):
        own = [f"t{k // 2}w{i}" for i in range(40)]
        rows.append((k, " ".join([*own[:-1], f"end{k}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {d: shingles.identity(t.encode()) - (1 << 64 if shingles.identity(t.encode()) >> 63 else 0) for d, t in rows}
    sets = {d: shingles.shingle_set(t.encode()) for d, t in rows}
    root = {d: prints[0] if d < 900 else prints[d] for d, _ in rows}
    told = spark.createDataFrame([(1, prints[d], root[d], len(sets[d])) for d, _ in rows], "s long, fp long, root long, n int")
    several = spark.createDataFrame([(1, 601, prints[0], 1500, 600)], "s long, parts long, big long, m long, q long")
    sizes = spark.createDataFrame([(prints[d], shingles.sketch(sets[d]).tolist()) for d, _ in rows], "fp long, k array<long>")
    across = shingles._across(told, several, sizes)
    got = {(r.a, r.b) for r in across.collect()}
    want = {tuple(sorted((prints[k], prints[k + 1]))) for k in range(900, 1500, 2)}
    assert got == want
    classes = {r.doc_id: r.component_id for r in shingles.shingle_groups(docs).collect()}
    assert classes == {d: 0 if d < 900 else d - d % 2 for d, _ in rows}


def test_near_copies_go_through_the_simhash_operator(spark, monkeypatch):
    """Its links are the first candidates; the exact join finds near copies of more than two bits."""
    calls, near_links = [], shingles.simhash.near_links

    def counted(distinct):
        calls.append(distinct.count())
        return near_links(distinct)

    monkeypatch.setattr(shingles.simhash, "near_links", counted)
    words = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join([*words[:200], "other", *words[201:]])), (4, "no text like any other one"), (5, None)]
    got = {r.doc_id: r.component_id for r in shingles.shingle_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5} and calls and calls[0] >= 3
    hashes = shingles.shingle_set(" ".join(words).encode())
    bits = [(hashes >> np.uint64(k)) & np.uint64(1) for k in range(64)]
    assert shingles.simhash.majority(hashes) == sum(1 << k for k, b in enumerate(bits) if 2 * b.sum() > len(hashes)) and shingles.simhash.majority(hashes[:0]) == 0
