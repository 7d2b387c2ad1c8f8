"""Every table of every report reads back as it was computed."""

import pytest
from pyspark.sql import functions as F

from checks.metric_queries import multi
from checks.registry import Data
from demur.operators import metrics as M
from demur.operators import multidoc as MD
from demur.operators import voting as V
from demur.plans import curation, datasets, reports
from demur.sources import readers as RD
from demur.sources import sinks as SK
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def data(spark):
    return Data(spark, SMALL)


def written(spark, path):
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def assert_same(spark, tables, path):
    for name, table in tables.items():
        got, want = written(spark, f"{path}/{name}"), table.select(*[F.col(c).cast("string").alias(c) for c in table.columns])
        rows = want.collect()
        if rows:  # a table without rows has a header at most
            assert got.columns == want.columns, name
        assert sorted(tuple(x or "" for x in r) for r in got.collect()) == sorted(tuple(x or "" for x in r) for r in rows), name


def plain(tables):
    """Tables that CSV can hold."""
    return {n: t for n, t in tables.items() if not any(f.dataType.typeName() in ("array", "map", "struct") for f in t.schema)}


COMPARE = reports.Comparisons(["model_1", "model_3"], {"model_0": 7, "model_4": 70}, ("model_1", "model_4"), [("model_0", "model_1"), ("model_2", "model_3")])


def test_metric_report(spark, data, tmp_path):
    reports.write_metric_report(data.results(), str(tmp_path), COMPARE)
    tables = reports.metric_tables(M.condense(data.results()), COMPARE)
    assert {"scaling", "budget", "alignment", "frontier"} <= set(tables) and tables["alignment"].count() == 3
    assert_same(spark, plain(tables), str(tmp_path))
    assert not {"scaling", "budget", "alignment", "frontier"} & set(reports.metric_tables(M.condense(data.results())))


def test_cross_dataset_report(spark, data, tmp_path):
    results = multi(data)
    reports.write_cross_dataset_report(data.results(), results, str(tmp_path), k=2)
    tables = reports.cross_dataset_tables(M.leaderboard(data.results()), MD.multidoc_frontier(results), k=2)
    assert tables["leaderboards"].count() == 10 and tables["top_multi"].count() == 2
    assert_same(spark, tables, str(tmp_path))


def test_agreement_report(spark, data, tmp_path):
    reports.write_agreement_report(data.votes(), str(tmp_path))
    assert_same(spark, plain(reports.agreement_tables(V.align(data.votes()))), str(tmp_path))


def test_multidoc_report(spark, data, tmp_path):
    results = multi(data)
    reports.write_multidoc_report(results, str(tmp_path))
    single = MD.as_single(results)
    tables = reports.multidoc_tables(results) | {
        "by_class": M.refusal_by_class(single), "by_intensity": M.refusal_by_intensity(single), "coverage": M.coverage_matrix(single),
    }
    assert_same(spark, plain(tables), str(tmp_path))


def test_dataset_files(spark, data, tmp_path):
    rows = datasets.stratified_dataset(data.votes())
    datasets.write_dataset(rows, str(tmp_path))
    back = spark.read.json(str(tmp_path / "dataset"))
    assert {r.unique_id for r in back.select("unique_id").collect()} == {r.unique_id for r in rows.select("unique_id").collect()}
    for name in ("metadata", "strata", "summary", "generators", "crosstab"):
        assert spark.read.json(str(tmp_path / name)).count() > 0, name
    assert spark.read.json(str(tmp_path / "metadata")).first().total_entries == back.count()
