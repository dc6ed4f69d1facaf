"""The pipeline's stages against plain versions."""

from __future__ import annotations

from pyspark.sql import functions as F

import pyarrow as pa

import corpus_pipeline
from test_shingles import _least
from graphloom.llm import language, mixing, packing, pii, shared

SF = "/root/testdata/sf0.01"


def test_stages_take_effect_and_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(9001, "123 456", "en", "s", 7), (9002, None, None, None, None), (9003, docs.first().text, "en", "s", 5), (9003, docs.first().text, "en", "s", 5), (None, "A text of no number at all, twice here.", "en", "s", 5), (None, "A text of no number at all, twice here.", "en", "s", 5), (None, "Quite another one of the texts that nobody has numbered.", "en", "s", 5)], docs.schema)
    rows = docs.union(junk)
    model = language.learn(rows)
    states = [rows]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, states[-1], SF).write.parquet(str(tmp_path / name))
        states.append(spark.read.parquet(str(tmp_path / name)))
    assert all(s.columns == docs.columns for s in states[:-1])
    key = lambda frame: sorted((r.doc_id or -1, r.text or "") for r in frame.collect())

    kept = [r for r in rows.collect() if model.classify(r.text)[0] != "und" and model.classify(r.text)[1] >= 0.5]
    assert key(states[1]) == sorted((r.doc_id or -1, r.text) for r in kept)

    texts = {r.doc_id: r.text for r in states[1].where("doc_id is not null").collect()}
    first = set(_least(list(texts.items())).values())
    assert sorted(r.doc_id for r in states[2].where("doc_id is not null").collect()) == sorted(first)
    assert states[2].where("doc_id is null").count() == 2 and states[2].exceptAll(rows).count() == 0
    assert len(first) < len({" ".join(t.lower().split()) for t in texts.values()})  # near copies go, too

    assert key(states[3]) == sorted((r.doc_id or -1, pii.replace(r.text, pii.session_key(spark))[0]) for r in states[2].collect())
    assert states[3].where(F.char_length("text") != F.col("n_chars")).count() == 0

    assert not set(key(states[4])) - set(key(states[3]))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = labels.where("quality = 1 and toxic = 0")
    before, after = (s.join(clean, "doc_id").count() for s in states[3:5])
    assert after >= 0.9 * before
    assert states[4].join(labels.where("toxic = 1"), "doc_id").count() <= 0.6 * states[3].join(labels.where("toxic = 1"), "doc_id").count()

    tokens = packing.op7(states[4]).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert tokens.exceptAll(states[5].groupBy("doc_id").agg(F.sum("length").alias("n"))).count() == 0


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0 and "sequence_id" in found.columns


def test_resampling_leaves_a_full_target_alone(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert mixing.resample(docs, labels, {"good": 1.0, "low": 1.0, "toxic": 1.0}).count() == docs.count()


def test_stages_keep_columns_of_any_name(spark):
    """Columns with the names that operators use inside, repeated ids and odd texts."""
    names = ["c0", "fp", "n", "id", "none", "words", "tokens", "posterior", "key", "root", "shard"]
    rows = [(1, None), (2, ""), (2, "Another text of a document that shares its number, about nothing much."), (3, "Some words of a text that is like no other one here."), (3, "Some words of a text that is like no other one here."), (None, "Call +1 (017) 555-7713 about the lamp, please, before the evening.")]
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'{n}' as `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns, name
        assert out.count() <= frame.count() and stage(spark, frame.limit(0), SF).count() == 0
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, frame, SF).collect()]
    assert sorted(kept, key=str) == sorted([(1, None), rows[2], rows[3], rows[5]], key=str)


def test_record_batches_are_bounded_by_bytes(spark):
    """A thousand long texts don't pass between Spark and Python at once, and none is lost."""
    long = spark.range(0, 1000, 1, 1).selectExpr("id", "repeat('word ', 4000) as text")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "rows"]) for b in batches)
    found = shared.map_batches(long, sizes, "bytes long, rows long").collect()
    assert sum(r.rows for r in found) == 1000
    assert max(r.bytes for r in found) < 2 * shared.BYTES
    spark.conf.set(shared.BYTES_SETTING, "512k")  # a smaller setting stays
    assert max(r.bytes for r in shared.map_batches(long, sizes, "bytes long, rows long").collect()) < 1 << 20
    spark.conf.set(shared.BYTES_SETTING, "64m")
    shared.map_batches(long, sizes, "bytes long, rows long")
    assert spark.conf.get(shared.BYTES_SETTING) == str(shared.BYTES)


def test_a_worker_drops_what_another_operator_remembers(spark):
    """Packing's pieces and tokenizer don't stay in the workers while another operator's tasks run there."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4)
    look = lambda batches: (pa.RecordBatch.from_arrays([pa.array([",".join(shared._held)])], ["held"]) for _ in batches)
    look.__module__ = packing.__name__
    packing.op7(docs).count()
    packing.op7(docs).write.format("noop").mode("overwrite").save()
    assert "graphloom.llm.packing" in {r.held for r in shared.map_batches(docs, look, "held string").collect()}
    look.__module__ = language.__name__
    assert {r.held for r in shared.map_batches(docs, look, "held string").collect()} == {""}
