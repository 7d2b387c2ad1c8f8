"""Shapes of physical plans that matter at scale."""

import re

import pytest

from checks.catalogue_of_queries import QUERIES
from checks.registry import Data
from demur.operators import matching, metrics, sampling, voting
from tests.conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def d(spark):
    return Data(spark, SMALL)


def test_leaderboard_is_one_aggregation(d):
    p = plan(metrics.leaderboard(d.results()))
    assert p.count("Exchange") == 1 and "hashpartitioning(model_id" in p
    assert "SortAggregate" not in p and "ObjectHashAggregate" not in p


def test_alignment_is_one_shuffle_without_texts(d):
    p = plan(voting.align(d.votes()))
    assert p.count("Exchange") == 1
    assert "SortAggregate" not in p and "ObjectHashAggregate" not in p
    exchange = p[p.index("Exchange"):].splitlines()[0]
    assert "perturbed_context" not in exchange


def test_no_window_holds_a_whole_generator(d):
    ids = sampling.stratified_ids(voting.unanimous_filter(voting.align(d.votes())), target=5000)
    windows = [line for line in plan(ids).splitlines() if " Window [" in line or "Window [" in line and "row_number" in line]
    ranks = [line for line in windows if "row_number" in line]
    assert ranks and all("_bucket" in line.split("windowspecdefinition")[1] for line in ranks)


def test_grids_are_generators_not_joins(d):
    for df in (matching.perturbation_grid(d.table("part")), matching.evaluation_grid(d.table("part"), ["a", "b"])):
        p = plan(df)
        assert "Generate" in p and "Join" not in p and "CartesianProduct" not in p


@pytest.mark.parametrize("key", [k for k in QUERIES if not k.startswith(("stream_", "read_", "write_", "append_", "count_", "number_", "filtered_", "metric_report", "agreement_report"))])
def test_no_python_and_no_cartesian_product(spark, key):
    p = plan(QUERIES[key](spark, SMALL))
    assert not re.search(r"PythonUDF|ArrowEval|BatchEvalPython|MapInPandas|FlatMapGroups", p)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "results.parquet")
    Data(spark, SMALL).results().write.parquet(path)
    p = plan(metrics.frontier_leaderboard(spark.read.parquet(path), ["model_1", "model_3"]))
    assert "In(model_id, [model_1,model_3])" in p.replace("'", "")
    assert "question_category" not in p and "raf_score" not in p
