"""The lever catalogue and the 18 cells as small fixed dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demur import vocab
from demur.functions.columns import col, literal_table
from demur.sources.levers import lever_rows


def catalogue(spark: SparkSession) -> DataFrame:
    """All 176 levers."""
    return literal_table(spark, ("perturbation_class", "intensity", "lever_no", "name", "instruction", "illustration"), lever_rows())


def all_cells(spark: SparkSession) -> DataFrame:
    """The 18 (class, intensity) combinations with expected label and both targets."""
    rows = [
        (c, i, vocab.ANSWER_LABEL if i == "LOW" else vocab.CODE_OF_CLASS[c], vocab.TARGET_SINGLE[c], vocab.TARGET_MULTI[c])
        for c, i in vocab.CELLS
    ]
    return literal_table(spark, ("perturbation_class", "intensity", "expected_label", "target_single", "target_multi"), rows)


def is_valid_cell(perturbation_class: str = "perturbation_class", intensity: str = "intensity") -> Column:
    return F.coalesce(col(perturbation_class).isin(*vocab.CLASSES) & col(intensity).isin(*vocab.INTENSITIES), F.lit(False))


def lever_counts(spark: SparkSession) -> DataFrame:
    return catalogue(spark).groupBy("perturbation_class", "intensity").agg(F.count(F.lit(1)).alias("levers"))


def with_levers(df: DataFrame) -> DataFrame:
    """Add the number of levers of each row's cell; an unknown cell gets an error text
    instead of failing the job."""
    counts = lever_counts(df.sparkSession)
    return df.join(F.broadcast(counts), ["perturbation_class", "intensity"], "left").withColumn(
        "cell_error", F.when(col("levers").isNull(), F.concat_ws(" ", F.lit("unknown cell"), "perturbation_class", "intensity"))
    )


def lever_menu(levers: DataFrame, by: Sequence[str] = ("perturbation_class", "intensity")) -> DataFrame:
    """Per cell (or cell and version) the numbered list of levers as shown to a model."""
    line = F.format_string("%d. **%s.** %s | %s", "lever_no", "name", "instruction", "illustration")
    lines = F.array_sort(F.collect_list(F.struct("lever_no", line.alias("line"))))  # at most 11 per cell
    return (
        levers.groupBy(*by).agg(lines.alias("lines"))
        .select(*by, F.array_join(F.col("lines.line"), "\n").alias("menu"), F.size("lines").alias("entries"))
    )
