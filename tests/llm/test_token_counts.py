"""Compiled token counts against the tokenizer library."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import token_counts

PATH = public_tokenizers.path(token_counts.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
PARTS = [*" \n\t'srvletmdLE1²½!<|>éß日 　\U0001f600\x1c​", "<|endoftext|>", "  ", "'re", "'ll", "'ve", " the", "ing"]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(PATH)


def expected(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), min_size=1, max_size=30))
def test_counts_of_contractions_white_space_and_marks(counter, texts):
    assert counter.counts(texts).tolist() == expected(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=20))
def test_counts_of_any_text(counter, texts):
    assert counter.counts(texts).tolist() == expected(texts)


def test_classes_are_those_of_the_library(counter):
    words = LIBRARY.pre_tokenizer.pre_tokenize_str
    kinds = {token_counts.NUMBER: "1", token_counts.OTHER: "!", token_counts.QUOTE: "!"} | dict.fromkeys(range(6), "a")
    for c in [*range(0x3000), *range(0xA000, 0xD800), *range(0xF900, 0x12000), *range(0x1E000, 0x20000)]:
        kind = int(counter.kinds[c])
        joined = [len(words(x + chr(c))) == 1 for x in "a1!"]
        assert joined == [x == kinds.get(kind) for x in "a1!"], hex(c)


def test_long_words_and_small_memories():
    """Words beyond any token's length, and machines that forget all the time."""
    texts = ["a" * 5000, "ab" * 3000 + " " * 999, "'" * 500, "\n" * 300, "xyzzy" * 200, "é" * 777, "the " * 2000 + "<|endoftext|>" * 3, ""]
    for remembered, chunk in ((3, 5), (50, 1), (10_000, 64)):
        counter = token_counts.Counter(PATH, remembered, chunk)
        assert counter.counts(texts).tolist() == expected(texts)
        assert counter.batched(pa.array([*texts, None]), tape=1000).tolist() == [*expected(texts), 0]
    assert token_counts.Counter(PATH).batched(pa.array([], pa.string())).tolist() == []


def test_every_state_map_is_composed(counter):
    """The prefix scan gives what reading from the first code point on gives."""
    kinds = np.random.default_rng(5).integers(0, 12, 4000).astype(np.uint8)
    kinds[-1] = token_counts.BREAK
    state, starts = token_counts.START, np.zeros(4000, bool)
    for k, kind in enumerate(kinds):
        said = counter.said[state, kind]
        starts[k] |= bool(said & token_counts.HERE)
        starts[k - 1] |= bool(said & token_counts.BEFORE)
        state = counter.after[state, kind]
    assert (counter.word_starts(kinds) == starts).all()


def test_vocabularies_that_can_not_be_compiled_are_refused():
    for name in ("word_bpe_49k.json",):
        with pytest.raises(ValueError):
            token_counts.Counter(public_tokenizers.path(name))


def test_rows_nulls_repeats_and_cut_texts(spark):
    words = "It's <|endoftext|> the  old\n\nmill, 日本 1234 words'll "
    rows = [(1, words * 40, "x"), (2, None, "x"), (2, "", "x"), (None, words, "x"), (4, words * 40, "x"), (4, words * 40, "x"), (5, "word" * 500, "x"), (6, " " * 700, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    want = sorted((str(r[0]), len((r[1] or "").encode()), n) for r, n in zip(rows, expected([r[1] for r in rows])))
    for piece in (100, 1 << 20):
        got = token_counts.token_counts(docs, PATH, piece=piece)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert token_counts.op11(docs.where("false")).collect() == []
    over = {r.n_tokens > 1024: r.over_limit for r in token_counts.op11(docs, limit=1024).collect()}
    assert all(k == v for k, v in over.items())


def test_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: n for r, n in zip(rows, expected([r.text for r in rows]))}
    assert {r.doc_id: r.n_tokens for r in token_counts.op11(docs).collect()} == want
