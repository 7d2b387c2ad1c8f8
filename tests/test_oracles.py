"""Every registered query against its SQL on DuckDB at the smallest scale."""

import pytest

from checks.catalogue_of_queries import ORACLES, QUERIES
from checks.compare import compare, duck
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("key", list(QUERIES))
def test_agrees_with_sql(spark, con, key):
    ok, text = compare(spark, con, key, SMALL, QUERIES, ORACLES)
    assert ok, text


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 5
    assert df.columns[0] == "model_id"
