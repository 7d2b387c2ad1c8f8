"""Every operator on null ids and texts, empty and long texts, repeated rows, empty tables and
columns whose names clash with its own."""

import pytest
from pyspark.sql import functions as F

from demur.llm import (
    alignment, byte_bpe, decontamination, exact_dedup, language_id, near_dedup, packing, personal_data, quality, repeats, token_counts,
    token_output,
)
from demur.llm.common import shared_folder


def written(docs):
    return token_output.read_tokens(token_output.write_tokens(docs, shared_folder(docs.sparkSession, "edges")))


PER_ROW = {
    "language_id": language_id.identify, "exact_dedup": exact_dedup.exact_dedup, "token_output": written, "near_dedup": near_dedup.near_duplicates,
    "repeats": repeats.remove_repeats, "personal_data": personal_data.find_personal_data, "token_lengths": token_counts.token_lengths,
    "token_alignment": alignment.align_tokens, "byte_bpe": lambda docs: byte_bpe.digests(byte_bpe.encode(docs)),
}


@pytest.mark.parametrize("name", list(PER_ROW))
def test_one_row_per_input_row(name, odd_docs):
    ids = sorted((r["doc_id"] for r in PER_ROW[name](odd_docs).select("doc_id").collect()), key=lambda d: -1 if d is None else d)
    assert ids == sorted((r["doc_id"] for r in odd_docs.select("doc_id").collect()), key=lambda d: -1 if d is None else d)


@pytest.mark.parametrize("name", list(PER_ROW))
def test_empty_table(name, no_docs):
    assert PER_ROW[name](no_docs).collect() == []


def test_other_operators_on_an_empty_table(no_docs, labels, spark):
    items = spark.createDataFrame([(1, "some words to look for in here")], "item_id long, text string")
    assert token_counts.length_histogram(no_docs).collect() == []
    assert packing.pack(no_docs).collect() == []
    assert quality.score_quality(no_docs, labels).collect() == []
    assert decontamination.find_items(no_docs, items).collect() == []
    assert decontamination.find_items(no_docs, items.limit(0)).collect() == []


def test_exact_dedup_keeps_one_of_each_text(odd_docs):
    out = exact_dedup.exact_dedup(odd_docs)
    kept = {r["text_sha256"]: r["k"] for r in out.groupBy("text_sha256").agg(F.count_if("kept").alias("k")).collect()}
    assert set(kept.values()) == {1}
    by_id = {(r["doc_id"], r["group_size"]) for r in out.collect()}
    assert (2, 4) in by_id and (6, 4) in by_id  # three ids with a row twice; two empty and two null texts


def test_stages_keep_columns(odd_docs, labels, spark):
    items = spark.createDataFrame([(1, "a quite different sentence that nobody has written down before")], "item_id long, text string")
    n = odd_docs.count()
    for out in (
        exact_dedup.drop_copies(odd_docs), near_dedup.drop_near_duplicates(odd_docs), quality.drop_low_quality(odd_docs, labels),
        decontamination.drop_contaminated(odd_docs, items),
    ):
        assert out.schema.names == odd_docs.schema.names
        assert out.count() <= n
    assert decontamination.drop_contaminated(odd_docs, items).count() == n
    assert decontamination.drop_contaminated(odd_docs, items.limit(0)).count() == n


def test_stages_on_an_empty_table(no_docs, labels, spark):
    items = spark.createDataFrame([(1, "some words to look for in here")], "item_id long, text string")
    assert exact_dedup.drop_copies(no_docs).collect() == []
    assert near_dedup.drop_near_duplicates(no_docs).collect() == []
    assert quality.drop_low_quality(no_docs, labels).collect() == []
    assert decontamination.drop_contaminated(no_docs, items).collect() == []


def test_without_labels_nothing_is_rejected(odd_docs, labels):
    assert quality.drop_low_quality(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert {r["score"] for r in quality.score_quality(odd_docs, labels.limit(0)).collect()} == {1.0}


def test_quality_of_odd_rows(odd_docs, labels):
    rows = quality.score_quality(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_copies_dropped(odd_docs):
    left = exact_dedup.drop_copies(odd_docs)
    assert left.filter("text like 'The quick%'").count() == 2
    near = near_dedup.drop_near_duplicates(odd_docs)
    assert near.filter("text like 'word0%'").count() == 1
    # texts without words are no copies of each other
    assert near.filter("doc_id in (4, 5, 6, 9)").count() == 4
