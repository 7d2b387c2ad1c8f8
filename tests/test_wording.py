"""Versions of the wording: what may be published, which version a row gets, prompts of several versions."""

import pytest
from pyspark.sql import functions as F

from demur.operators import prompts as T
from demur.sources import wording as WD


@pytest.fixture(scope="module")
def words(spark):
    return T.default_wording(spark).cache()


def times(spark, *at):
    return spark.createDataFrame([(i, a) for i, a in enumerate(at)], "i int, at string").withColumn("at", F.col("at").cast("timestamp"))


def test_the_default_wording_can_be_published_and_comes_back_whole(spark, words, tmp_path):
    path = str(tmp_path / "w")
    assert WD.publish(words, path, "v1", "2024-01-01") and not WD.publish(words.limit(0).unionByName(words), path, "v1", "2025-01-01")
    back = WD.read(spark, path)
    assert back.count() == 176
    assert back.drop("wording_version", "valid_from").exceptAll(words.select(*back.columns[:-2])).count() == 0
    assert [(r.wording_version, r.valid_to) for r in WD.timeline(back).collect()] == [("v1", None)]


CELL = "(perturbation_class = 'P-Ambiguity' AND intensity = 'LOW')"


def in_cell(value, other):
    return F.when(F.expr(CELL), value).otherwise(F.col(other))


@pytest.mark.parametrize("change, fault", [
    (lambda w: w.filter(f"NOT {CELL}"), "no levers"),
    (lambda w: w.filter(f"NOT {CELL} OR lever_no <> 3"), "not numbered"),
    (lambda w: w.withColumn("name", in_cell(F.lit("same"), "name")), "occurs twice"),
    (lambda w: w.withColumn("instruction", in_cell(F.lit(" "), "instruction")), "empty texts"),
    (lambda w: w.withColumn("strategy", in_cell(F.lit(None), "strategy")), "empty texts"),
    (lambda w: w.withColumn("criteria", in_cell(F.col("name"), "criteria")), "several criteria"),
    (lambda w: w.withColumn("intensity", in_cell(F.lit("NONE"), "intensity")), "unknown cell"),
])
def test_a_faulty_wording_is_refused(spark, words, tmp_path, change, fault):
    with pytest.raises(ValueError, match=fault):
        WD.publish(change(words), str(tmp_path / "w"), "v1", "2024-01-01")
    assert WD.read(spark, str(tmp_path / "w")).count() == 0


def test_a_row_gets_the_version_of_its_time(spark, words, tmp_path):
    path = str(tmp_path / "w")
    rows = times(spark, "2023-12-31 23:59:59", "2024-01-01 00:00:00", "2024-01-31 23:59:59", "2024-02-01 00:00:00", "2030-01-01 00:00:00", None)
    assert {r.wording_version for r in WD.as_of(rows, WD.read(spark, path), "at").collect()} == {None}
    for name, start in (("b", "2024-02-01"), ("a", "2024-01-01"), ("c", "2024-02-01")):  # the later name counts from February on
        WD.publish(words, path, name, start)
    out = WD.as_of(rows, WD.read(spark, path), "at")
    assert [r.wording_version for r in out.orderBy("i").collect()] == [None, "a", "a", "c", "c", None]
    assert out.columns == ["i", "at", "wording_version"]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_prompts_of_two_versions_in_one_run(spark, words, tmp_path):
    path = str(tmp_path / "w")
    WD.publish(words, path, "old", "2024-01-01")
    WD.publish(words.withColumn("criteria", F.lit("new criteria")).filter("lever_no <= 2"), path, "new", "2024-02-01")
    every = WD.read(spark, path)
    ins = spark.createDataFrame(
        [(1, "q1", "what?", "a text", ["yes"], "2024-01-05"), (2, "q2", "who?", "a text", ["no"], "2024-02-05")],
        "line_no bigint, qid string, query string, context string, answers array<string>, at string",
    ).withColumn("at", F.col("at").cast("timestamp"))
    out = T.generator_requests(WD.as_of(ins, every, "at"), wording=every).collect()
    assert len(out) == 36
    plain = {(r.source_qid, r.perturbation_class, r.intensity): r for r in T.generator_requests(ins).collect()}
    for r in out:
        same = plain[r.source_qid, r.perturbation_class, r.intensity]
        assert r.request_id == same.request_id  # asking again in other words asks for the same
        if r.source_qid == "q1":
            assert r.wording_version == "old" and r.prompt == same.prompt
        else:
            assert r.wording_version == "new" and "CRITERIA: new criteria\n" in r.prompt and r.prompt.count(". **") == 2


def test_a_row_without_a_version_is_an_error(spark, words, tmp_path):
    path = str(tmp_path / "w")
    WD.publish(words, path, "v1", "2024-01-01")
    ins = spark.createDataFrame([(1, "q1", "what?", "a text", ["yes"], None)], "line_no bigint, qid string, query string, context string, answers array<string>, at timestamp")
    every = WD.read(spark, path)
    with pytest.raises(Exception, match="no wording is valid"):
        T.generator_requests(WD.as_of(ins, every, "at"), wording=every).collect()


def test_a_wording_without_versions_replaces_the_one_in_the_code(spark, words):
    ins = spark.createDataFrame([(1, "q1", "what?", "a text", ["yes"])], "line_no bigint, qid string, query string, context string, answers array<string>")
    out = T.generator_requests(ins, wording=words.withColumn("criteria", F.lit("others"))).collect()
    assert len(out) == 18 and all("CRITERIA: others\n" in r.prompt for r in out) and "wording_version" not in out[0].asDict()
