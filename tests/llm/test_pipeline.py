"""The corpus pipeline and the registered queries against brute force on the smallest tables."""

import numpy as np
import pytest
import sentencepiece as library
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quire.llm import language_id
from quire.llm.catalog import PIECES, queries
from quire.session import REQUIRED_CONF, configure
from tests.llm.test_joins import brute_contamination, brute_groups, brute_lines


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    extra = spark.createDataFrame([(90001, None, None, "s", 0), (90002, "12 34", "en", "s", 5), (90003, "", None, "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "decontamination", "sentencepiece"]
    first = stages["language_id"](spark, docs, sf).cache()
    assert first.columns == docs.columns
    given, kept = rows_of(docs), rows_of(first)
    assert set(given) - set(kept) == {90001, 90002, 90003} and all(kept[k].text == given[k].text for k in kept)
    second = stages["line_dedup"](spark, first, sf).cache()
    want = brute_lines([(k, r.text) for k, r in kept.items()], 2, 40, 1)
    want = {k: t for k, t in want.items() if t.strip() or t == kept[k].text}
    cut = rows_of(second)
    assert second.columns == docs.columns and {k: r.text for k, r in cut.items()} == want
    assert all(r.n_chars == len(r.text) for k, r in cut.items() if r.text != kept[k].text)
    third = stages["ngram_jaccard_join"](spark, second, sf).cache()
    assert third.columns == docs.columns
    assert {str(k) for k in rows_of(third)} == {d for d, _, c in brute_groups([(k, r.text) for k, r in cut.items()]) if d == c}
    fourth = stages["decontamination"](spark, third, sf).cache()
    left = rows_of(third)
    assert fourth.columns == docs.columns
    assert {str(k) for k in rows_of(fourth)} == {d for d, _, n, _ in brute_contamination([(k, r.text) for k, r in left.items()], items) if not n}
    pieces = library.SentencePieceProcessor(model_file=PIECES)
    last = rows_of(stages["sentencepiece"](spark, fourth, sf))
    assert set(last) == set(rows_of(fourth))
    assert all(r.ids == pieces.encode(left[k].text) and r.n_tokens == len(r.ids) for k, r in last.items())


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_applies_settings(spark, sf, name):
    """A stage that is called alone bounds its batches as the registered queries do."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for key in REQUIRED_CONF:
        spark.conf.unset(key)
    try:
        dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
        assert {key: spark.conf.get(key) for key in REQUIRED_CONF} == corpus_pipeline.SETTINGS
    finally:
        configure(spark)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_gives_memory_back(spark, sf, monkeypatch, name):
    """What earlier stages left in the executors is collected before a stage begins."""
    steps = []
    monkeypatch.setattr(corpus_pipeline, "give_back", lambda session: steps.append(session))
    with pytest.raises(AttributeError):  # these are no documents
        dict(corpus_pipeline.STAGES)[name](spark, None, sf)
    assert steps == [spark]


def test_give_back(spark):
    """Unused objects go although they are old; local tasks share the driver's heap."""
    left = spark._jvm.java.lang.StringBuilder("left by an earlier stage")
    seen = spark._jvm.java.lang.ref.WeakReference(left)
    spark._jvm.System.gc()  # from now on it is old, and small collections leave it alone
    spark.sparkContext._gateway.detach(left)
    for _ in range(10):  # the gateway's threads may still hold it at first
        corpus_pipeline.give_back(spark)
        if seen.get() is None:
            break
    assert seen.get() is None


def test_registry():
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] == list(queries()) and "pipeline" in names
    assert len({n.split("_")[0] for n in queries()}) == 13
    assert set(entry.oracle_sql()) <= set(names)


def test_language_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = queries()["op5_language_id"](spark, sf)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == docs.count()
    held = out.join(docs, "doc_id").where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.95
    assert out.where(~F.col("score").between(0, 1)).isEmpty()
    assert {r.lang_pred for r in out.select("lang_pred").distinct().collect()} <= {language_id.UNDETERMINED} | {r.lang for r in docs.select("lang").distinct().collect()}


@pytest.mark.parametrize("name", ["op6_line_dedup"])
def test_line_query(spark, sf, name):
    import hashlib
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_lines(docs, 2, 40, 1)
    got = {r.doc_id: r.text_sha256 for r in queries()[name](spark, sf).collect()}
    assert got == {k: None if t is None else hashlib.sha256(t.encode()).hexdigest() for k, t in want.items()}


def test_training_drops_kept_objects(monkeypatch):
    """The tasks that train the language model drop what an earlier stage left in the worker, and give its memory back."""
    from quire.llm import language_id, worker
    trimmed = []
    monkeypatch.setattr(worker, "trim", lambda: trimmed.append(1))
    model = language_id.PieceModel(["a"], ["x"], np.ones((2, 1)))
    for run in (language_id._word_counts, language_id._expectation(model)):
        held = worker.kept("an encoder", lambda: [0] * 10)
        assert worker.kept("an encoder", list) is held
        trimmed.clear()
        list(run(iter([])))
        assert trimmed == [1]
        assert worker.kept("an encoder", list) == []
    worker.kept("another", list)
    assert trimmed == [1, 1]
    monkeypatch.undo()
    worker.trim()
