"""Multi-document evaluation metrics (support scores instead of quality scores).

Expects the multi-document result schema: ``is_answerable``, ``refusal_classification``,
``raf_score`` (claims supported by the relevant passages), ``eligibility_score``,
``unadjusted_factuality_score``, ``refusal_match_correct``, ``false_refusal``,
``missed_refusal``. The same rule as in ``metrics`` applies: one aggregation, combined
before the shuffle, then arithmetic on one row per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demur import vocab
from demur.functions.columns import col, harmonic, percent, ratio

HIGH_SUPPORT = 0.8


def as_multidoc(results: DataFrame) -> DataFrame:
    """Give single-document results the multi-document column names."""
    return results.withColumnsRenamed(
        {"ground_truth_label": "expected_behavior", "model_predicted_type": "refusal_classification"}
    )


def as_single(results: DataFrame) -> DataFrame:
    """Give multi-document results the column names of ``metrics``, for its confusion,
    class, intensity and coverage tables."""
    return results.withColumnsRenamed(
        {"expected_behavior": "ground_truth_label", "refusal_classification": "model_predicted_type"}
    )


def _ans() -> Column:
    return col("is_answerable").eqNullSafe(F.lit(True))


def _unans() -> Column:
    return col("is_answerable").eqNullSafe(F.lit(False))


def _attempt() -> Column:
    return col("refusal_classification").eqNullSafe(F.lit(vocab.ATTEMPT))


def _flag(c: str) -> Column:
    return col(c).cast("int")


def _where(cond: Column, c: Column) -> Column:
    return F.when(cond, c)


def _zero_if_empty(mean: str, n: str) -> Column:
    return F.when(col(n) == 0, F.lit(0.0)).otherwise(col(mean))


def multidoc_metrics(results: DataFrame) -> DataFrame:
    t = results.groupBy("model_id").agg(
        F.avg(_where(_ans(), col("eligibility_score"))).alias("elig"),
        F.avg(_where(_ans(), col("unadjusted_factuality_score"))).alias("fact"),
        F.avg(_where(_ans(), col("raf_score"))).alias("raf"),
        F.avg(_where(_ans(), _flag("false_refusal"))).alias("fr"),
        F.avg(_where(_unans(), _flag("refusal_match_correct"))).alias("match"),
        F.avg(_where(_unans(), _flag("missed_refusal"))).alias("mr"),
        F.count_if(_unans() & ~_attempt()).alias("refused"),
        F.count_if(_ans()).alias("num_answerable"),
        F.count_if(_unans()).alias("num_unanswerable"),
    )
    return t.select(
        "model_id",
        _zero_if_empty("elig", "num_answerable").alias("eligibility"),
        _zero_if_empty("fact", "num_answerable").alias("unadjusted_factuality"),
        _zero_if_empty("raf", "num_answerable").alias("raf"),
        _zero_if_empty("fr", "num_answerable").alias("false_refusal_rate"),
        _zero_if_empty("match", "num_unanswerable").alias("refusal_accuracy"),
        _zero_if_empty("mr", "num_unanswerable").alias("missed_refusal_rate"),
        ratio("refused", "num_unanswerable").alias("overall_refusal_rate"),
        "num_answerable",
        "num_unanswerable",
    )


def hybrid_score(metrics: DataFrame) -> DataFrame:
    """Support score and refusal accuracy weighted by their numbers of rows."""
    n = col("num_answerable") + col("num_unanswerable")
    both = ratio("num_answerable", n) * col("raf") + ratio("num_unanswerable", n) * col("refusal_accuracy")
    return metrics.withColumn(
        "hybrid_score",
        F.when((col("num_answerable") > 0) & (col("num_unanswerable") > 0), both)
        .when(col("num_answerable") > 0, col("raf"))
        .when(col("num_unanswerable") > 0, col("refusal_accuracy"))
        .otherwise(F.lit(0.0)),
    )


DIMENSIONS = ("perturbation_class", "question_category", "question_type", "question_complexity")


def breakdowns(results: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Counts and means per model and value of each dimension, long format.

    The rows are summed once per (model, combination of dimensions); the grouping sets
    then expand that small table instead of every result row. A mean is null where its
    side is empty.
    """
    base = results.groupBy("model_id", *dims).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(_ans()).alias("n_a"), F.count_if(_unans()).alias("n_u"),
        F.sum(_where(_ans(), col("raf_score").cast("double"))).alias("raf"), F.count(_where(_ans(), col("raf_score"))).alias("raf_n"),
        F.sum(_where(_ans(), col("eligibility_score").cast("double"))).alias("elig"),
        F.count(_where(_ans(), col("eligibility_score"))).alias("elig_n"),
        F.sum(_where(_unans(), _flag("refusal_match_correct"))).alias("match"),
        F.count(_where(_unans(), col("refusal_match_correct"))).alias("match_n"),
    )
    sets = [["model_id", d] for d in dims]
    grouped = base.groupingSets(sets, "model_id", *dims).agg(
        F.grouping_id().alias("gid"),
        *[F.sum(c).alias(c) for c in ("n", "n_a", "n_u", "raf", "raf_n", "elig", "elig_n", "match", "match_n")],
    )
    # grouping_id has a 0 bit for the columns that are grouped by; model_id is the top bit
    width = len(dims)
    ids = {((1 << width) - 1) & ~(1 << (width - 1 - i)): d for i, d in enumerate(dims)}
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for gid, d in ids.items():
        name = F.when(col("gid") == gid, F.lit(d)).otherwise(name)
        value = F.when(col("gid") == gid, col(d)).otherwise(value)

    def mean(s: str, n: str) -> Column:
        return col(s) / F.nullif(col(n), F.lit(0))

    return grouped.select(
        "model_id", name.alias("dimension"), value.alias("value"),
        col("n").alias("total_count"), col("n_a").alias("answerable_count"), col("n_u").alias("unanswerable_count"),
        mean("raf", "raf_n").alias("raf"),
        F.when(name == "question_category", mean("elig", "elig_n")).alias("eligibility"),
        mean("match", "match_n").alias("refusal_accuracy"),
    )


def top_domains(table: DataFrame, k: int = 3, dims: Sequence[str] = ("question_category", "perturbation_class")) -> DataFrame:
    """The k largest values per model of the given dimensions, by number of rows."""
    order = Window.partitionBy("model_id", "dimension").orderBy(F.desc("total_count"), "value")
    return (
        table.filter(col("dimension").isin(*dims))
        .withColumn("position", F.row_number().over(order))
        .filter(col("position") <= k)
        .select("model_id", "dimension", "position", "value", "total_count", "raf", "refusal_accuracy")
    )


def multidoc_frontier(results: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Leaderboard on support scores, optionally for a named list of models."""
    if models is not None:
        results = results.filter(col("model_id").isin(*models))
    t = results.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("total_instances"), F.count_if(_ans()).alias("answerable_instances"),
        F.count_if(_unans()).alias("unanswerable_instances"),
        F.count_if(_ans() & _attempt()).alias("ans_att"), F.count_if(_ans() & ~_attempt()).alias("ans_ref"),
        F.count_if(_unans() & _attempt()).alias("un_att"), F.count_if(_unans() & ~_attempt()).alias("un_ref"),
        F.count_if(~_attempt()).alias("refusals"),
        F.avg(_where(_ans() & _attempt(), col("raf_score"))).alias("raf"),
        F.avg(_where(_unans(), _flag("refusal_match_correct"))).alias("match"),
        F.avg(_where(_unans() & ~_attempt(), _flag("refusal_match_correct"))).alias("cat"),
    )
    quality = F.when(col("ans_att") == 0, F.lit(0.0)).otherwise(col("raf"))
    refusal = _zero_if_empty("match", "unanswerable_instances")
    precision, recall = ratio("un_ref", "refusals"), ratio("un_ref", "unanswerable_instances")
    f1 = harmonic(precision, recall)
    category = _zero_if_empty("cat", "un_ref")
    return t.select(
        "model_id", quality.alias("answer_quality_score"), refusal.alias("refusal_accuracy"),
        (F.lit(0.5) * quality + F.lit(0.5) * refusal).alias("calibrated_refusal_score"),
        ratio("ans_ref", "answerable_instances").alias("false_refusal_rate"),
        ratio("un_att", "unanswerable_instances").alias("missed_refusal_rate"),
        precision.alias("refusal_precision"), recall.alias("refusal_recall"), f1.alias("refusal_detection_f1"),
        category.alias("category_accuracy"), (f1 * category).alias("hierarchical_refusal_score"),
        ratio("refusals", "total_instances").alias("refusal_volume"),
        "total_instances", "answerable_instances", "unanswerable_instances",
    )


def response_distribution(results: DataFrame) -> DataFrame:
    """Six shares in percent of all rows. They overlap: a false refusal with support 0
    also counts as a low-quality answer."""
    raf, match = col("raf_score"), col("refusal_match_correct")
    t = results.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(_ans() & (raf >= HIGH_SUPPORT)).alias("high"), F.count_if(_ans() & (raf < HIGH_SUPPORT)).alias("low"),
        F.count_if(_unans() & ~_attempt() & match).alias("right"), F.count_if(_unans() & ~_attempt() & ~match).alias("wrong"),
        F.count_if(_ans() & ~_attempt()).alias("false"), F.count_if(_unans() & _attempt()).alias("missed"),
    )
    return t.select(
        "model_id", percent("high", "n").alias("high_quality_answers"), percent("low", "n").alias("low_quality_answers"),
        percent("right", "n").alias("correct_refusals"), percent("wrong", "n").alias("wrong_refusals"),
        percent("false", "n").alias("false_refusals"), percent("missed", "n").alias("missed_refusals"),
    )


def answer_quality(results: DataFrame) -> DataFrame:
    """Mean support over the answerable rows that have a score, and the share of high ones."""
    scored = _ans() & col("raf_score").isNotNull()
    t = results.groupBy("model_id").agg(
        F.sum(_where(scored, col("raf_score").cast("double"))).alias("raf"), F.count_if(scored).alias("n"),
        F.count_if(scored & (col("raf_score") >= HIGH_SUPPORT)).alias("high"),
        F.avg(_where(_unans(), _flag("refusal_match_correct"))).alias("match"), F.count_if(_unans()).alias("n_u"),
    )
    quality, refusal = ratio("raf", "n"), _zero_if_empty("match", "n_u")
    return t.select(
        "model_id", quality.alias("answer_quality_score"), ratio("high", "n").alias("high_quality_answer_rate"),
        refusal.alias("refusal_accuracy"), (F.lit(0.5) * quality + F.lit(0.5) * refusal).alias("calibrated_refusal_score"),
    )


def domain_performance(results: DataFrame, domain: str = "question_category") -> DataFrame:
    """Per domain, and per model and domain: support of the attempts and match rate."""
    base = results.groupBy("model_id", col(domain).alias("domain")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(_ans()).alias("n_a"), F.count_if(_unans()).alias("n_u"),
        F.count_if(_ans() & _attempt()).alias("att"),
        F.sum(_where(_ans() & _attempt(), col("raf_score").cast("double"))).alias("raf"),
        F.count(_where(_ans() & _attempt(), col("raf_score"))).alias("raf_n"),
        F.sum(_where(_unans(), _flag("refusal_match_correct"))).alias("match"),
        F.count(_where(_unans(), col("refusal_match_correct"))).alias("match_n"),
    )
    sums = [F.sum(c).alias(c) for c in ("n", "n_a", "n_u", "att", "raf", "raf_n", "match", "match_n")]
    grouped = base.groupingSets([["domain"], ["model_id", "domain"]], "model_id", "domain").agg(F.grouping("model_id").alias("all_models"), *sums)

    def mean(s: str, n: str, rows: str) -> Column:
        return F.when(col(rows) == 0, F.lit(0.0)).otherwise(col(s) / F.nullif(col(n), F.lit(0)))

    return grouped.select(
        F.when(col("all_models") == 1, F.lit("all")).otherwise(col("model_id")).alias("model_id"), "domain",
        mean("raf", "raf_n", "att").alias("raf_score"), mean("match", "match_n", "n_u").alias("refusal_accuracy"),
        col("n").alias("total_instances"), col("n_a").alias("answerable_instances"), col("n_u").alias("unanswerable_instances"),
    )
