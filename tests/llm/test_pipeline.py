"""The pipeline against a plain version over its own stages' rules, and every registered query against its SQL."""

import pytest

import corpus_pipeline as C
from quire.llm import pii, registry
from quire.llm.common import materialize


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck, data, same_rows):
    got = registry.QUERIES[name](spark, data).toPandas()
    assert len(got) > 0
    if name in registry.ORACLES:
        same_rows(got, duck.sql(registry.ORACLES[name]).df())


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    before = {}
    for name, stage in C.STAGES:
        before[name] = docs
        docs = materialize(stage(spark, docs, data), name)
        if name != "packing":
            assert docs.columns == columns
        counts.append(docs.count())
    # good documents stay in the classifier, near copies leave one each
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = {r.doc_id for r in before["simhash_near_dedup"].select("doc_id").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    texts = [r.text for r in before["pii"].collect()]
    assert len(set(texts)) == len(texts)
    raw = {r.doc_id: r.text for r in before["pii"].collect()}
    assert all(r.text == pii.mask(raw[r.doc_id]) and r.n_chars == len(r.text) for r in before["mixing"].collect())
    # each copy of the mixture is packed as a whole
    copies = before["packing"].count()
    assert sum(r.length for r in docs.collect()) == sum(r.doc_tokens for r in docs.where("start = 0").collect()) and docs.where("start = 0").count() == copies


def test_run_gives_the_last_stage(spark, data):
    assert {"doc_id", "sequence_id", "offset"} <= set(C.run(spark, data).columns)


@pytest.mark.parametrize("stage", [f for n, f in C.STAGES if n != "quality_classifier"])
def test_empty_input(spark, data, none, stage):
    assert stage(spark, none.select("doc_id", "text", "lang", "source", "n_chars"), data).count() == 0


def test_odd_rows_go_through_all_stages(spark, data, odd):
    """Nulls, empty and long texts, repeated rows and clashing column names."""
    docs, n = odd, odd.count()
    for name, stage in C.STAGES:
        before = docs.count()
        docs = materialize(stage(spark, docs, data), name)
        if name != "packing":
            assert docs.columns == odd.columns
        if name in ("quality_classifier", "simhash_near_dedup", "pii"):
            assert docs.count() <= before <= n
    assert docs.count() > 0


def test_empty_input_of_the_first_stage(spark, data, none):
    assert C.quality_classifier(spark, none, data).count() == 0
