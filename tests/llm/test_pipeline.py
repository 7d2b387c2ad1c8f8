"""Every stage of the pipeline on what the stage before it kept, against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from demur.llm import quality, words
from tests.conftest import SMALL
from tests.llm.test_texts import _classes, _contained


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_order_and_columns(stages):
    assert list(stages) == ["quality_classifier", "exact_dedup", "near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for name in list(stages)[:-1]:
        before, after = stages[name]
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < after.count() <= before.count()
        # kept rows are unchanged
        assert after.exceptAll(before).count() == 0


def test_quality_rejects_what_the_operator_scores_low(spark, stages):
    before, after = stages["quality_classifier"]
    scored = quality.score_quality(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert set(texts(after)) == {r["doc_id"] for r in scored.filter("predicted = 1").collect()}
    assert after.count() < before.count()


def test_exact_copies(stages):
    before, after = stages["exact_dedup"]
    last = {}
    for doc_id, text in sorted(texts(before).items()):
        last[text] = doc_id
    assert set(texts(after)) == set(last.values())


def test_near_copies(stages):
    before, after = stages["near_dedup"]
    assert set(texts(after)) == set(_classes(list(texts(before).items())).values())


def test_decontamination(spark, stages):
    before, after = stages["benchmark_decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hit = {d for d, *_ in _contained(list(texts(before).items()), items)}
    assert set(texts(after)) == set(texts(before)) - hit


def test_packing(stages):
    before, after = stages["best_fit_packing"]
    encoder = words.encoder(words.vocabulary_path())
    lengths = {d: len(encoder.library(t)) // 4 + 1 for d, t in texts(before).items()}
    rows = after.collect()
    found = {}
    for r in rows:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert found == lengths
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 4096
    assert len(used) <= np.ceil(sum(lengths.values()) / 4096) + 2


def test_run_is_all_stages(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert corpus_pipeline.run(spark, SMALL).select(columns).exceptAll(stages["best_fit_packing"][1].select(columns)).count() == 0


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name != "best_fit_packing":
                assert out.columns == docs.columns
                assert out.count() <= docs.count()
            else:
                assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
