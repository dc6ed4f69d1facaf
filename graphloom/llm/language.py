"""Language identification, word first with backoff to character n-grams.

A known word scores its logarithmic frequency in each language. An unknown word
is scored by its character n-grams, the longest known ones covering it: from
each place the longest of ``ORDERS`` that was learned counts, shorter ones
otherwise. The language with the greatest sum wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, materialize, slices

ORDERS = (4, 3, 2, 1)
#: Labelled documents that are learned from, per language, in the mean; the model holds all their words that occur twice, and all their n-grams.
SAMPLE = 500
#: Words that a worker remembers with their scores, and the length of those; neither changes a result.
REMEMBERED, SHORT, UNKNOWN = 100_000, 64, "und"
_run = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    found = _run.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # re's word characters hold numerals such as ½, ², Ⅷ and ①, too
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _grams(word: str) -> Iterator[str]:
    padded = f"\x02{word}\x03"
    for n in ORDERS:
        for i in range(len(padded) - n + 1):
            yield padded[i : i + n]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a partition; n-grams are prefixed, which words are not."""
    words: Counter[tuple[str, str]] = Counter()

    def told() -> pa.RecordBatch:
        counts: Counter[tuple[str, str]] = Counter(words)
        for (lang, word), n in words.items():
            for gram in _grams(word):
                counts[lang, "#" + gram] += n
        words.clear()
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "token", "n"])

    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word in words_of(text):
                words[lang, word] += 1
        if len(words) > 50_000:
            yield told()
    yield told()


class Model:
    """Log frequencies by language, a row of ``table`` for each known word and n-gram; ``classify`` scores whole texts."""

    def __init__(self, langs: list[str], words: dict[str, int], grams: dict[str, int], table: np.ndarray, floor: np.ndarray):
        self.langs, self.words, self.grams, self.logs, self.floor = langs, words, grams, table, floor
        self.rows: dict[str, int] = {}  # places in the table of words met so far
        self.table, self.used = np.empty((1024, len(langs))), 0

    def __reduce__(self) -> tuple:
        return Model, (self.langs, self.words, self.grams, self.logs, self.floor)

    def backoff(self, word: str) -> np.ndarray:
        padded, at, total, parts = f"\x02{word}\x03", 0, np.zeros(len(self.langs)), 0
        while at < len(padded):
            for n in ORDERS:
                found = self.grams.get(padded[at : at + n])
                if found is not None:
                    break
            total = total + (self.floor if found is None else self.logs[found])
            parts += 1
            at += max(1, min(n, len(padded) - at) - 1) if found is not None else 1
        return total / max(parts, 1)

    def row(self, word: str) -> int:
        """Place of a word that was not met before."""
        found = self.words.get(word)
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[self.used] = self.backoff(word) if found is None else self.logs[found]
        if len(word) <= SHORT:
            self.rows[word] = self.used
        self.used += 1
        return self.used - 1

    def classify(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text or ""))
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        if self.used >= REMEMBERED:
            self.rows, self.table, self.used = {}, self.table[:REMEMBERED], 0
        known, row = self.rows.get, self.row
        places = [k if (k := known(w)) is not None else row(w) for w in counts]
        total = np.fromiter(counts.values(), float, len(counts)) @ self.table[places]
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.minimum(0, total - total[best])).sum())


def learn(docs: DataFrame, per_language: int = SAMPLE) -> Model:
    """Fit on a sample of labelled rows: about ``per_language`` of each language, by a hash of doc_id.

    The sample's size is bounded by that parameter; with fewer labelled rows all
    are used. Held-out rows (crc32(doc_id) mod 5 = 0) and rows without text or
    language are never learned from. Without labelled rows every text is `und`.
    """
    labelled = docs.where(~held_out() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.where("text is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], {}, {}, np.zeros((0, 0)), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))]), F.col("lang"))
    drawn = (F.xxhash64("doc_id", F.lit("sample")).bitwiseAND((1 << 30) - 1) / float(1 << 30)) < share
    sample = labelled.where(drawn & F.col("text").isNotNull()).select("lang", "text")
    counts = map_batches(sample, _count, "lang string, token string, n long").groupBy("token", "lang").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    wide = counts.groupBy("token").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)])
    wide = materialize(wide, "counts")
    gram = F.col("token").startswith("#")

    def table(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
        got = rows.toPandas()  # bounded by the sample
        n = got[[f"n{i}" for i in range(len(langs))]].to_numpy(float).reshape(-1, len(langs))
        sums = np.maximum(n.sum(0), 1)
        return got["token"].tolist(), np.log((n + 0.5) / (sums + 0.5 * max(1, len(n)))), np.log(0.5 / (sums + 0.5 * max(1, len(n))))

    words, scores, _ = table(wide.where(~gram & (F.col("all") >= 2)))
    grams, more, floor = table(wide.where(gram).withColumn("token", F.substr("token", F.lit(2))))
    return Model(langs, {w: k for k, w in enumerate(words)}, {g: len(words) + k for k, g in enumerate(grams)}, np.concatenate([scores, more]), floor)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for each row of ``docs``.

    The prediction reads the text alone. Null texts and texts without a letter
    are `und` with score 0. Repeated rows repeat; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = list(map(shared.value.classify, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([min(1.0, x[1]) for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), predict, "doc_id long, lang_pred string, score double")


def op6(docs: DataFrame) -> DataFrame:
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, unchanged, whose language is identified with at least that score."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))
    names = docs.columns

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = names.index("text")
        for batch in slices(batches):
            found = map(shared.value.classify, batch.column(place).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return map_batches(docs, sift, docs.schema)
