"""Versions of the wording that prompts are made of: levers, criteria and strategies as a table.

A version is a whole wording with the time from which it is valid. Versions are appended once
each and never changed, so a run can be repeated with the wording it had. Rows are given the
version that was valid at their own time, without a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demur import vocab
from demur.functions.columns import col, literal_table, only_value
from demur.sources import tables

CELL = ("perturbation_class", "intensity")
VERSION = "wording_version"
SCHEMA = (
    "perturbation_class string, intensity string, lever_no int, name string, instruction string, illustration string, criteria string, strategy string"
)
_TEXTS = ("name", "instruction", "criteria", "strategy")
_COLUMNS = tuple(f.strip().split()[0] for f in SCHEMA.split(","))


def faults(wording: DataFrame) -> DataFrame:
    """What keeps a wording from being published: ``perturbation_class``, ``intensity``, ``fault``; no rows if nothing does.

    Every one of the 18 cells needs levers numbered from 1 without gaps, each with its own name
    and an instruction, and one text of criteria and one strategy.
    """
    cells = literal_table(wording.sparkSession, CELL, vocab.CELLS).withColumn("_known", F.lit(True))
    blank = F.lit(False)
    for c in _TEXTS:
        blank = blank | F.coalesce(F.trim(col(c)) == "", F.lit(True))
    found = wording.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("lever_no").alias("numbers"), F.min("lever_no").alias("least"), F.max("lever_no").alias("most"),
        F.count_distinct("name").alias("names"), F.count_if(blank).alias("blanks"),
        F.count_distinct("criteria").alias("criteria"), F.count_distinct("strategy").alias("strategies"),
    )
    both = cells.join(found, list(CELL), "full")
    fault = (
        F.when(col("_known").isNull(), "unknown cell").when(col("n").isNull(), "no levers").when(col("blanks") > 0, "empty texts")
        .when((col("numbers") != col("n")) | (col("least") != 1) | (col("most") != col("n")), "levers are not numbered from 1")
        .when(col("names") != col("n"), "a name occurs twice").when((col("criteria") != 1) | (col("strategies") != 1), "several criteria or strategies")
    )
    return both.select(*CELL, fault.alias("fault")).filter(col("fault").isNotNull())


def publish(wording: DataFrame, path: str, version: str, valid_from: str) -> bool:
    """Add a version, valid from a time on (``2024-05-01 12:00:00``). False if the version is there already."""
    wrong = faults(wording).orderBy(*CELL).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.perturbation_class} {r.intensity}: {r.fault}" for r in wrong))
    rows = wording.select(*_COLUMNS).withColumns({VERSION: F.lit(version), "valid_from": F.lit(valid_from).cast("timestamp")})
    return tables.append_batch(rows.coalesce(1), path, version)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All versions, a row per version and lever."""
    return tables.read_batches(spark, path, f"{SCHEMA}, {VERSION} string, valid_from timestamp")


def timeline(wording: DataFrame) -> DataFrame:
    """Per version from when and until when (excluded, null: still) it is valid; of two from the same time on the later name counts."""
    each = wording.select(VERSION, "valid_from").distinct()
    following = F.lead("valid_from").over(Window.orderBy("valid_from", VERSION))  # a row per version
    return each.select(VERSION, "valid_from", following.alias("valid_to"))


def as_of(rows: DataFrame, wording: DataFrame, at: str) -> DataFrame:
    """Rows with the version valid at the time in column ``at``; null before the first version or without a time.

    The versions and their times are one array, sorted, out of a scalar subquery: nothing is shuffled or joined.
    """
    each = wording.select("valid_from", VERSION).distinct()
    every = only_value(each.agg(F.array_sort(F.collect_list(F.struct("valid_from", VERSION)))))  # a row per version
    valid = F.filter("_versions", lambda v: v["valid_from"] <= col(at))
    return rows.withColumn("_versions", every).withColumn(VERSION, F.try_element_at(valid, F.lit(-1))[VERSION]).drop("_versions")
