"""Appended and merged tables: repeated batches, crashes between writing and committing, plans of reads."""

import pytest
from pyspark.sql import functions as F

from demur.operators import metrics as M
from demur.operators import voting as V
from demur.sources import sinks as SK
from demur.sources import tables as TB
from demur.streaming import results as R

ROWS = "sample_id string, model_id string, ground_truth_label string, model_predicted_type string, answer_quality_score double, refusal_match_correct boolean, seq bigint"


def results(spark, ids, kind="answer_attempt", seq=0, model="m"):
    return spark.createDataFrame([(f"s{k}", model, "ANSWER_CORRECTLY", kind, 5.0 if kind == "answer_attempt" else None, None, seq) for k in ids], ROWS)


def test_a_batch_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert TB.append_batch(results(spark, range(5)), path, "run 1/a")
    assert not TB.append_batch(results(spark, range(5)), path, "run 1/a")
    assert TB.append_batch(results(spark, range(5, 7)).withColumn("extra", F.lit(1)), path, "run 1/b")
    assert TB.batches(spark, path) == ["run 1/a", "run 1/b"]
    rows = TB.read_batches(spark, path)
    assert rows.count() == 7 and rows.filter("extra = 1").count() == 2


def test_an_append_that_crashes_before_its_record_does_not_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    TB.append_batch(results(spark, range(3)), path, "a")

    def crash(*_):
        raise OSError("gone")

    monkeypatch.setattr(TB, "publish", crash)
    with pytest.raises(OSError, match="gone"):
        TB.append_batch(results(spark, range(9)), path, "b")
    assert TB.read_batches(spark, path).count() == 3  # all or nothing for a reader in between
    monkeypatch.undo()
    assert TB.append_batch(results(spark, range(9)), path, "b")
    assert TB.read_batches(spark, path).count() == 12


def test_of_two_writers_of_a_record_one_wins(spark, tmp_path):
    path = str(tmp_path / "x" / "record")
    assert TB.publish(spark, path, "one") and not TB.publish(spark, path, "two")
    assert TB._read(spark, path) == "one"
    assert [n for n in TB.names(spark, str(tmp_path / "x")) if not n.startswith(".")] == ["record"]


def test_many_commits_are_read_by_tasks(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(35):
        TB.append_batch(spark.range(1).select(F.lit(k).alias("k")).coalesce(1), path, f"b{k:03d}")
    assert sorted(r.k for r in TB.read_batches(spark, path).collect()) == list(range(35))


def test_an_empty_table_needs_a_schema(spark, tmp_path):
    assert TB.read_batches(spark, str(tmp_path / "no"), "a int").collect() == []
    assert TB.read_merged(spark, str(tmp_path / "no"), "a int").collect() == []
    with pytest.raises(ValueError, match="schema"):
        TB.read_batches(spark, str(tmp_path / "no"))


def test_merged_rows_counts_and_leaderboard(spark, tmp_path):
    path = str(tmp_path / "results")
    parts = [
        results(spark, range(40)).unionByName(results(spark, range(20), model="n")),
        results(spark, range(30, 50), "ERROR", 1), results(spark, [3, 3, 3], "REFUSE_OTHER", 2).withColumn("seq", F.monotonically_increasing_id()),
        results(spark, [3], "answer_attempt"),
    ]
    for k, part in enumerate(parts):
        assert R.merge_results(part, path, "job", k, buckets=8)
        assert not R.merge_results(part, path, "job", k, buckets=8)  # repeated after a restart
        rows = TB.read_merged(spark, path)
        assert rows.count() == rows.select("sample_id", "model_id").distinct().count()
        want = {tuple(r) for r in M.leaderboard(rows).collect()}
        assert {tuple(r) for r in M.leaderboard(R.counts(spark, path)).collect()} == want
    last = {(r.sample_id, r.model_id): r.model_predicted_type for r in TB.read_merged(spark, path).collect()}
    assert len(last) == 70 and last["s3", "m"] == "answer_attempt" and last["s35", "m"] == "ERROR" and last["s3", "n"] == "answer_attempt"
    p = {r.model_id: (r.finished, r.distinct_samples, r.remaining, r.size_mismatch) for r in R.progress(spark, path, ["m", "n", "o"], 50).collect()}
    assert p == {"m": (64, 50, 0, False), "n": (20, 20, 30, True), "o": (0, 0, 50, True)}


def test_reading_a_merged_table_is_a_scan(spark, tmp_path):
    path = str(tmp_path / "results")
    for k in range(3):
        R.merge_results(results(spark, range(k, 30)), path, "job", k, buckets=4)
    plan = TB.read_merged(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and not any(x in plan for x in ("Window", "Exchange", "Aggregate", "Sort"))


def test_untouched_buckets_are_not_read_or_written(spark, tmp_path):
    path = str(tmp_path / "results")
    R.merge_results(results(spark, range(200)), path, "job", 0, buckets=16)
    before = TB.version(spark, path)
    R.merge_results(results(spark, [7], "ERROR"), path, "job", 1, buckets=16)
    after = TB.version(spark, path)
    assert sum(before.folders[b] != after.folders[b] for b in before.folders) == 1
    own = next(b for b in before.folders if before.folders[b] != after.folders[b])
    files = TB._rows(spark, path, before, [int(own)]).inputFiles()
    assert files and all(f"_bucket={own}/" in f for f in files)


def test_a_crash_between_data_and_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    R.merge_results(results(spark, range(10)), path, "job", 0)
    real = TB.publish
    monkeypatch.setattr(TB, "publish", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        R.merge_results(results(spark, range(5), "ERROR"), path, "job", 1)
    monkeypatch.setattr(TB, "publish", real)
    assert TB.read_merged(spark, path).filter("model_predicted_type = 'ERROR'").count() == 0
    assert R.merge_results(results(spark, range(5), "ERROR"), path, "job", 1)
    assert TB.read_merged(spark, path).filter("model_predicted_type = 'ERROR'").count() == 5
    leftovers = {n for n in TB.names(spark, f"{path}/data")}
    TB.vacuum(spark, path, keep=1)
    assert len(leftovers) == 3 and len(TB.names(spark, f"{path}/data")) <= 2
    assert TB.read_merged(spark, path).count() == 10 and M.leaderboard(R.counts(spark, path)).count() == 1


def test_a_second_writer_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    R.merge_results(results(spark, range(3)), path, "job", 0)
    stale = TB.version(spark, path)
    R.merge_results(results(spark, range(3), "ERROR"), path, "job", 1)
    monkeypatch.setattr(TB, "version", lambda *_: stale)
    with pytest.raises(RuntimeError, match="someone else"):
        R.merge_results(results(spark, range(3), "REFUSE_OTHER"), path, "other", 0)


def test_a_restarted_stream_merges_new_files_only(spark, tmp_path, monkeypatch):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def drop(name, rows):
        SK.write_jsonl(rows.coalesce(1), f"{source}/{name}")
        R.stream_results(spark, source, ROWS, target, checkpoint, buckets=4).awaitTermination()

    drop("a", results(spark, range(6)))
    real = TB.publish
    monkeypatch.setattr(TB, "publish", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(Exception, match="gone"):
        drop("b", results(spark, range(3), "ERROR"))
    monkeypatch.setattr(TB, "publish", real)
    R.stream_results(spark, source, ROWS, target, checkpoint, buckets=4).awaitTermination()
    R.stream_results(spark, source, ROWS, target, checkpoint, buckets=4).awaitTermination()  # nothing new
    assert {(r.sample_id, r.model_predicted_type) for r in TB.read_merged(spark, target).collect()} == {
        *((f"s{k}", "ERROR") for k in range(3)), *((f"s{k}", "answer_attempt") for k in range(3, 6))
    }
    assert {(r.status, r.n) for r in R.status(spark, target).collect()} == {("failed", 3), ("finished", 3)}


VOTES = """generator_model string, verifier_model string, source_qid string, perturbed_query string, perturbed_context string,
    perturbation_class string, intensity string, lever_selected string, verification_successful boolean, verification_result string, line_no bigint"""


def test_votes_merged_in_any_number_of_batches(spark, tmp_path):
    rows = [
        ("g", v, "q", f"p{k % 5}", "c", "P-Ambiguity", "LOW", "l", k % 7 != 0, "PASS" if k % 3 else "FAIL", k)
        for k in range(60) for v in ("claude", "nova", "gpt", "deepseek") if (k + len(v)) % 4
    ]
    whole = spark.createDataFrame(rows, VOTES)
    for k in range(3):
        R.merge_votes(whole.filter(F.col("line_no") % 3 == k), str(tmp_path / "v"), "logs", k, buckets=4)
        R.merge_votes(whole.filter(F.col("line_no") % 3 == k), str(tmp_path / "v"), "logs", k, buckets=4)
    got, want = R.aligned(spark, str(tmp_path / "v")), V.align(whole)
    assert got.schema.names == want.schema.names
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
