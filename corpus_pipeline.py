"""The corpus pipeline: language, near duplicates, personal data, mixture, packing.

Each stage takes what its predecessor kept, with the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import language, mixing, packing, pii, shingles, simhash
from graphloom.llm.shared import scratch_path

#: Pieces that a packing worker remembers: few, as the workers hold what earlier stages left.
REMEMBERED = 100_000
#: Of its own expected tokens, each domain keeps that share.
SHARES = {"good": 1.0, "low": 0.5, "toxic": 0.0}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay; null texts and texts without a letter go. Columns of any names."""
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word similarity 0.8 or more stays: that with the least doc_id.

    Null, empty and blank texts are one group; texts that share a doc_id are told
    apart; a group without any doc_id keeps one of its rows.
    """
    return simhash.one_of_each(docs, shingles.shingle_groups, shingles.identity)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates; n_chars is that of the new text, null for a null text.

    Entities that met in one surrogate are drawn again; more than ``pii.MOST_DRAWN`` of them, which only a
    broken detector makes, are an error.
    """
    done = pii.checked(docs, pii.session_key(spark))
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay by the rates that bring the domains to their targets; texts without words like others of their posterior."""
    return mixing.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), SHARES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null text is one piece, the end id."""
    return packing.op7(docs, REMEMBERED)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("surrogates", surrogates), ("mixture", mixture), ("packing", pack)]

#: Trained classifiers and the tokenizer are not for SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
