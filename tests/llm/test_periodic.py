"""Runs of repeated words against a search over all lags."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import periodic


def plain_runs(words, least=24):
    """Every lag, every stretch; a stretch whose words have a smaller period is that period's."""
    found, n = {}, len(words)
    for lag in range(1, n // 3 + 1):
        at = 0
        while at + lag < n:
            stop = at
            while stop + lag < n and words[stop] == words[stop + lag]:
                stop += 1
            length = stop + lag - at
            if stop > at and length >= max(least, 3 * lag):
                found.setdefault((at, length), lag)
            at = stop + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(a == b for a, b in zip(words, words[q:])))


@st.composite
def texts(draw):
    words = draw(st.lists(st.integers(0, draw(st.sampled_from([0, 1, 2, 6, 30]))), max_size=150))
    for _ in range(draw(st.integers(0, 3))):
        if words:
            at, period, reach = draw(st.integers(0, len(words) - 1)), draw(st.integers(1, 14)), draw(st.integers(0, 90))
            for k in range(at + period, min(len(words), at + reach)):
                words[k] = words[k - period]
    return words


@settings(max_examples=400, deadline=None)
@given(texts(), st.sampled_from([None, 0, 1, 3, 1e9]))
def test_runs_are_those_of_a_search_over_all_lags(words, heavy):
    found = periodic.runs(np.array(words, np.int64), heavy=heavy)
    assert found == plain_runs(words)
    for start, length, period in found:
        assert smallest_period(words[start : start + length]) == period
    stays = [not any(s + q <= i < s + n for s, n, q in found) for i in range(len(words))]
    assert periodic.collapsed(len(words), found).tolist() == stays


@pytest.mark.parametrize("kinds", [2, 9, 4000])
@pytest.mark.parametrize("heavy", [None, 0, 25, 1e9])
def test_counts_of_lags_are_exact(kinds, heavy):
    ids = np.random.default_rng(kinds).integers(0, kinds, 5000)
    ids[2000:2900] = ids[1990:2000].tolist() * 90
    want = [0, *(int(np.sum(ids[q:] == ids[:-q])) for q in range(1, 5000 // 3 + 1))]
    assert periodic.lag_matches(ids, heavy).tolist() == want


def test_long_periods_and_texts_of_few_words_are_quick():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 120_000)
    ids[30_000:90_000] = np.tile(ids[30_000:50_000], 3)
    assert (30_000, 60_000, 20_000) in [(s, n, q) for s, n, q in periodic.runs(ids)]
    assert periodic.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert all(n >= max(24, 3 * q) for _, n, q in periodic.runs(rng.integers(0, 2, 60_000)))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(kept)))


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in df.collect()), key=str)


def test_odd_rows(spark):
    repeat = "one two two \x1cthree\n" * 30
    tenth = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(1, repeat), (1, repeat), (2, None), (3, ""), (4, " \x0b\x0c\r\n\t "), (None, repeat + "end"), (tenth, " ".join(map(str, range(300)))), (tenth, ""), (7, "a " * 24), (8, "a " * 23), (9, "x y z " * 8 + "x w")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, runs string")
    assert rows_of(periodic.op12(docs)) == sorted((plain_row(*r) for r in rows), key=str)
    assert periodic.op12(docs.where("false")).collect() == []


def test_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 30_000]
    ids = {d for d, _ in short}
    got = [r for r in rows_of(periodic.op12(docs)) if r[0] in ids]
    assert got == sorted((plain_row(*r) for r in short), key=str)
    assert sum(r[1] > 0 for r in got) > 5


def test_reports_have_spans_and_texts(spark):
    docs = spark.createDataFrame([(1, "start " + "so it goes " * 10 + "end")], "doc_id long, text string")
    row = periodic.run_report(docs, texts=True).first()
    assert [tuple(r) for r in row.runs] == [(1, 30, 3)] and row.collapsed_text == "start so it goes end"
    assert hashlib.sha256(row.collapsed_text.encode()).hexdigest() == row.collapsed_sha256
