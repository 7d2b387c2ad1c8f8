"""Registry of checked queries: a Spark callable and, where possible, its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures
from demur.plans.shared import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Data:
    """The fixtures of one scale-factor folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def fixture(self, name: str) -> DataFrame:
        return fixtures.fixture(self.spark, self.sf_dir, name)

    def sql(self, text: str) -> DataFrame:
        return fixtures.on_spark(self.spark, self.sf_dir, text)

    def results(self) -> DataFrame:
        return self.fixture("eval_results")

    def votes(self) -> DataFrame:
        return self.fixture("verifications")

    def scratch(self) -> str:
        return shared_path(self.spark, "check")


def query(key: str, sql: str | None = None):
    """Register fn(Data) -> DataFrame under a key, with the SQL that must agree."""

    def register(fn: Callable[[Data], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = fixtures.for_duckdb(sql)
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Round columns that hold sums of doubles, whose last bit depends on the order."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
