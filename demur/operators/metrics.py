"""Single-document evaluation metrics.

Every metric is arithmetic over a few named counts, and the counts come from one
hash aggregation on the grouping keys (``tally``). The counts are combined before the
shuffle, so a model that owns a third of all rows costs one row per task, and what is
shuffled is (groups x tasks) narrow rows however long the answer texts are.

Two definitions of the headline metrics exist side by side: ``evaluator_metrics``
counts failed (ERROR) rows in the denominator of refusal accuracy, ``leaderboard``
leaves them out and treats everything but an answer attempt as a refusal.
A mean over rows that are all null is null; an empty group gives 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demur import vocab
from demur.functions.columns import col, harmonic, literal_table, only_value, ratio

GOOD_SCORE = 4  # quality scores run from 1 to 5
_CLASS_CODE = "REFUSE_(" + "|".join(c.removeprefix("REFUSE_") for c in vocab.CLASS_CODES) + ")"


def answerable() -> Column:
    return col("ground_truth_label").eqNullSafe(F.lit(vocab.ANSWER_LABEL))


def attempted() -> Column:
    return col("model_predicted_type").eqNullSafe(F.lit(vocab.ATTEMPT))


def is_correct() -> Column:
    """Answerable: an attempt scored 4 or 5. Otherwise: the refusal code matched."""
    good = attempted() & (col("answer_quality_score") >= GOOD_SCORE)
    return F.when(answerable(), good).otherwise(col("refusal_match_correct").eqNullSafe(F.lit(True)))


def _conditions() -> dict[str, Column]:
    ans, att = answerable(), attempted()
    coded = col("model_predicted_type").isin(*vocab.REFUSAL_CODES)
    match = col("refusal_match_correct")
    return {
        "total_instances": F.lit(True),
        "answerable_instances": ans,
        "unanswerable_instances": ~ans,
        "good_answers": ans & att & (col("answer_quality_score") >= GOOD_SCORE),
        "answerable_refused": ans & ~att,
        "answerable_coded": ans & coded,
        "unanswerable_refused": ~ans & ~att,
        "unanswerable_coded": ~ans & coded,
        "unanswerable_attempted": ~ans & att,
        "matched": ~ans & match,
        "match_known": ~ans & match.isNotNull(),
        "refused_matched": ~ans & ~att & match,
        "refused_mismatched": ~ans & ~att & ~match,
        "correct": is_correct(),
    }


WEIGHT = "row_count"
_CONDENSED_BY = (
    "model_id", "ground_truth_label", "model_predicted_type", "perturbation_class", "intensity", "generator_model",
    "confidence_level", "refusal_match_correct",
)


def condense(results: DataFrame) -> DataFrame:
    """Results as counts per combination of the columns the metrics look at.

    The combinations are few (models x labels x types x cells x levels) whatever the
    number of rows. All functions of this module that count rows take a condensed table as
    well as a plain one, so a report reads the results once.
    """
    keys = [c for c in _CONDENSED_BY if c in results.columns]
    # only the side of the threshold matters for a score
    score = F.when(col("answer_quality_score") >= GOOD_SCORE, float(GOOD_SCORE)).when(col("answer_quality_score").isNotNull(), 1.0)
    return results.groupBy(*keys, score.alias("answer_quality_score")).agg(F.count(F.lit(1)).alias(WEIGHT))


def count_where(results: DataFrame, cond: Column) -> Column:
    """Rows meeting a condition, weighted in a condensed table."""
    if WEIGHT in results.columns:
        return F.coalesce(F.sum(F.when(cond, col(WEIGHT))), F.lit(0).cast("long"))
    return F.count_if(cond)


def tally(results: DataFrame, keys: Sequence[str], *names: str) -> DataFrame:
    """One aggregation: for each group, how many rows meet each named condition."""
    conditions = _conditions()
    return results.groupBy(*keys).agg(*[count_where(results, conditions[n]).alias(n) for n in names])


def _mean_or_zero(num: str, known: str, rows: str) -> Column:
    """Mean of a nullable flag: 0 for an empty group, null when no flag is known."""
    return F.when(col(rows) == 0, F.lit(0.0)).otherwise(col(num) / F.nullif(col(known), F.lit(0)))


def evaluator_metrics(results: DataFrame) -> DataFrame:
    t = tally(
        results, ["model_id"], "answerable_instances", "unanswerable_instances", "good_answers",
        "answerable_coded", "matched", "unanswerable_coded", "unanswerable_attempted",
    )
    accuracy = ratio("good_answers", "answerable_instances")
    refusal = ratio("matched", "unanswerable_instances")
    return t.select(
        "model_id",
        accuracy.alias("accuracy"),
        ratio("answerable_coded", "answerable_instances").alias("false_refusal_rate"),
        refusal.alias("refusal_accuracy"),
        ratio("unanswerable_coded", "unanswerable_instances").alias("overall_refusal_rate"),
        ratio("unanswerable_attempted", "unanswerable_instances").alias("missed_refusal_rate"),
        (F.lit(0.5) * accuracy + F.lit(0.5) * refusal).alias("calibrated_refusal_score"),
        col("answerable_instances").alias("num_answerable"),
        col("unanswerable_instances").alias("num_unanswerable"),
    )


_BOARD_COUNTS = (
    "total_instances", "answerable_instances", "unanswerable_instances", "good_answers", "answerable_refused",
    "unanswerable_refused", "unanswerable_attempted", "matched", "match_known", "refused_matched",
)


def _board_columns() -> dict[str, Column]:
    answer = ratio("good_answers", "answerable_instances")
    refusal = _mean_or_zero("matched", "match_known", "unanswerable_instances")
    precision = ratio("unanswerable_refused", col("answerable_refused") + col("unanswerable_refused"))
    recall = ratio("unanswerable_refused", "unanswerable_instances")
    f1 = harmonic(precision, recall)
    category = ratio("refused_matched", "unanswerable_refused")
    return {
        "answer_accuracy": answer,
        "refusal_accuracy": refusal,
        "calibrated_refusal_score": F.lit(0.5) * answer + F.lit(0.5) * refusal,
        "false_refusal_rate": ratio("answerable_refused", "answerable_instances"),
        "missed_refusal_rate": ratio("unanswerable_attempted", "unanswerable_instances"),
        "overall_refusal_rate": recall,
        "refusal_precision": precision,
        "refusal_recall": recall,
        "refusal_detection_f1": f1,
        "category_accuracy": category,
        "hierarchical_refusal_score": f1 * category,
        "total_instances": col("total_instances"),
        "answerable_instances": col("answerable_instances"),
        "unanswerable_instances": col("unanswerable_instances"),
    }


def leaderboard(results: DataFrame) -> DataFrame:
    """One row per model: accuracies, error rates, refusal detection, combined scores."""
    t = tally(results, ["model_id"], *_BOARD_COUNTS)
    return t.select("model_id", *[c.alias(n) for n, c in _board_columns().items()])


def ranked_leaderboard(results: DataFrame) -> DataFrame:
    """The leaderboard in descending order of the calibrated refusal score."""
    return leaderboard(results).orderBy(F.desc("calibrated_refusal_score"), "model_id")


def frontier_leaderboard(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """The leaderboard of a named list; the filter reaches the scan."""
    return leaderboard(results.filter(col("model_id").isin(*models)))


def model_ranking(board: DataFrame, metric: str = "calibrated_refusal_score") -> DataFrame:
    # one row per model, so a single window partition is small by construction
    order = Window.orderBy(F.desc(metric))
    return board.select("model_id", col(metric), F.rank().over(order).alias("rank"))


def top_k(df: DataFrame, metric: str, k: int, tie: Sequence[str] = ("model_id",)) -> DataFrame:
    return df.orderBy(F.desc(metric), *tie).limit(k)


# --- confusion ------------------------------------------------------------------


def confusion_matrix(results: DataFrame, by_intensity: bool = False) -> DataFrame:
    """Counts of (expected code, predicted type) over the unanswerable rows."""
    keys = ["model_id"] + (["intensity"] if by_intensity else [])
    return (
        results.filter(~answerable())
        .groupBy(*keys, "ground_truth_label", "model_predicted_type")
        .agg(count_where(results, F.lit(True)).alias("n"))
    )


def mean_confusion(confusion: DataFrame) -> DataFrame:
    """Average cell count over the models present; a model without the cell adds 0."""
    models = only_value(confusion.agg(F.count_distinct("model_id")))
    total = confusion.groupBy("ground_truth_label", "model_predicted_type").agg(F.sum("n").alias("n"))
    return total.select("ground_truth_label", "model_predicted_type", (col("n") / models).alias("mean_n"))


def cohen_kappa(results: DataFrame) -> DataFrame:
    """Agreement of expected and predicted label beyond chance, unanswerable rows."""
    label = F.inline(
        F.array(
            F.struct(
                col("ground_truth_label").alias("label"), col("n").alias("expected"), F.lit(0).cast("long").alias("predicted"),
                F.when(col("ground_truth_label") == col("model_predicted_type"), col("n")).otherwise(0).cast("long").alias("same"),
            ),
            F.struct(
                col("model_predicted_type").alias("label"), F.lit(0).cast("long").alias("expected"), col("n").alias("predicted"),
                F.lit(0).cast("long").alias("same"),
            ),
        )
    )
    margins = (
        confusion_matrix(results)
        .select("model_id", label)
        .groupBy("model_id", "label")
        .agg(F.sum("expected").alias("e"), F.sum("predicted").alias("p"), F.sum("same").alias("same"))
        .groupBy("model_id")
        .agg(
            F.sum("e").alias("n"), F.sum("same").alias("same"),
            F.sum(col("e").cast("double") * col("p").cast("double")).alias("cross"),
        )
    )
    observed = col("same") / col("n")
    chance = col("cross") / (col("n").cast("double") * col("n").cast("double"))
    return margins.select(
        "model_id",
        observed.alias("observed_agreement"),
        chance.alias("expected_agreement"),
        ratio(observed - chance, F.lit(1.0) - chance).alias("cohen_kappa"),
    )


# --- calibration ----------------------------------------------------------------


def _midpoints(ranges: Mapping[str, tuple[float, float]]) -> Column:
    pairs = [x for level, (lo, hi) in ranges.items() for x in (F.lit(level), F.lit((lo + hi) / 2))]
    return F.try_element_at(F.create_map(*pairs), col("confidence_level"))


def _require_confidence(results: DataFrame) -> None:
    if "confidence_level" not in results.columns:
        raise ValueError("calibration needs the column confidence_level")


def reliability_bins(results: DataFrame, bins: Mapping[str, tuple[float, float]] = vocab.CONFIDENCE_RANGES) -> DataFrame:
    """Observed accuracy against the midpoint of each stated confidence level."""
    _require_confidence(results)
    t = tally(
        results.filter(col("confidence_level").isin(*bins)), ["model_id", "confidence_level"], "total_instances", "correct"
    )
    accuracy = col("correct") / col("total_instances")
    return t.select(
        "model_id", "confidence_level", accuracy.alias("accuracy"), _midpoints(bins).alias("confidence"),
        col("total_instances").alias("count"), F.abs(accuracy - _midpoints(bins)).alias("gap"),
    )


def _per_level(results: DataFrame, bins: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Counts per model and level, also for levels outside the bins (midpoint null)."""
    _require_confidence(results)
    ok = is_correct()
    ans = answerable()
    return (
        results.groupBy("model_id", "confidence_level")
        .agg(
            *[
                count_where(results, cond).alias(name)
                for name, cond in (
                    ("n", F.lit(True)), ("ok", ok), ("n_a", ans), ("ok_a", ans & ok), ("n_r", ~ans), ("ok_r", ~ans & ok)
                )
            ]
        )
        .withColumn("mid", _midpoints(bins))
    )


def _gap(ok: str, n: str) -> Column:
    """Rows times |accuracy - midpoint|; 0 for an empty bin, null outside the bins."""
    return F.when(
        col("mid").isNotNull(), col(n) * F.abs(ratio(ok, n) - col("mid"))
    )


def calibration_error(results: DataFrame, bins: Mapping[str, tuple[float, float]] = vocab.CONFIDENCE_RANGES) -> DataFrame:
    """Expected calibration error per model over the rows with a known level."""
    levels = _per_level(results, bins)
    return (
        levels.groupBy("model_id")
        .agg(
            F.coalesce(F.sum(_gap("ok", "n")), F.lit(0.0)).alias("gap"),
            F.coalesce(F.sum(F.when(col("mid").isNotNull(), col("n"))), F.lit(0)).alias("binned"),
            F.sum("n").alias("n"), F.sum("ok").alias("ok"),
        )
        .select(
            "model_id", ratio("gap", "binned").alias("expected_calibration_error"),
            (col("ok") / col("n")).alias("overall_accuracy"), col("binned").alias("total_samples"),
        )
    )


def calibration_decomposed(results: DataFrame, bins: Mapping[str, tuple[float, float]] = vocab.CONFIDENCE_RANGES) -> DataFrame:
    """Calibration error overall, on answerable and on unanswerable rows.

    The two parts divide by all answerable (unanswerable) rows, binned or not.
    """
    levels = _per_level(results, bins)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0))

    return (
        levels.groupBy("model_id")
        .agg(
            total(_gap("ok", "n")).alias("gap"), total(_gap("ok_a", "n_a")).alias("gap_a"), total(_gap("ok_r", "n_r")).alias("gap_r"),
            F.coalesce(F.sum(F.when(col("mid").isNotNull(), col("n"))), F.lit(0)).alias("binned"),
            F.sum("n_a").alias("n_a"), F.sum("n_r").alias("n_r"),
        )
        .select(
            "model_id", ratio("gap", "binned").alias("ece_overall"), ratio("gap_a", "n_a").alias("ece_answer"),
            ratio("gap_r", "n_r").alias("ece_refusal"),
        )
    )


# --- breakdowns -------------------------------------------------------------------


def refusal_by_class(results: DataFrame) -> DataFrame:
    """Per model and class code contained in the expected label."""
    code = F.regexp_extract(col("ground_truth_label"), _CLASS_CODE, 1)
    t = tally(
        results.withColumn("perturbation_type", code).filter(F.length("perturbation_type") > 0),
        ["model_id", "perturbation_type"], "total_instances", "unanswerable_refused", "matched", "match_known",
    )
    return t.select(
        "model_id", "perturbation_type",
        (col("matched") / F.nullif(col("match_known"), F.lit(0))).alias("refusal_accuracy"),
        (col("unanswerable_refused") / col("total_instances")).alias("refusal_rate"),
        col("total_instances").alias("instances"),
    )


def model_class_distribution(results: DataFrame) -> DataFrame:
    return refusal_by_class(results).select(
        "model_id", "perturbation_type", "refusal_rate", col("refusal_accuracy").alias("accuracy"), "instances"
    )


def refusal_by_intensity(results: DataFrame) -> DataFrame:
    t = tally(
        results.filter(~answerable() & col("intensity").isin(*vocab.INTENSITIES)),
        ["model_id", "intensity"], "total_instances", "unanswerable_refused", "matched", "match_known",
    )
    return t.select(
        "model_id", "intensity",
        (col("matched") / F.nullif(col("match_known"), F.lit(0))).alias("refusal_accuracy"),
        (col("unanswerable_refused") / col("total_instances")).alias("refusal_rate"),
        col("total_instances").alias("instances"),
    )


def coverage_matrix(results: DataFrame, by: str = "code") -> DataFrame:
    """Row counts of all 18 cells, 0 where empty.

    ``by='code'`` reads the class from the refusal code in the expected label, which
    leaves every LOW cell at 0 because LOW rows are answerable; ``by='class'`` reads
    the perturbation class.
    """
    if by == "code":
        name = F.regexp_extract(col("ground_truth_label"), _CLASS_CODE, 1)
        classes = [c[7:] for c in vocab.CLASS_CODES]
    else:
        name = col("perturbation_class")
        classes = list(vocab.CLASSES)
    counts = results.groupBy(name.alias("class_name"), "intensity").agg(count_where(results, F.lit(True)).alias("n"))
    cells = literal_table(
        results.sparkSession, ("class_name", "intensity"), [(c, i) for c in classes for i in vocab.INTENSITIES]
    )
    return cells.join(counts, ["class_name", "intensity"], "left").select(
        "class_name", "intensity", F.coalesce("n", F.lit(0)).alias("n")
    )


# --- comparisons over a finished leaderboard ------------------------------------------

_COMPARED = ("answer_accuracy", "refusal_accuracy", "calibrated_refusal_score")


def scaling_table(board: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """The compared metrics beside each model's size in billions of parameters; models without a size are left out."""
    size = literal_table(board.sparkSession, ("model_id", "size_b"), list(sizes.items()))
    return board.join(size, "model_id").select("model_id", "size_b", *_COMPARED)


def metric_pairs(board: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Named model pairs side by side; a pair with a model missing is left out.

    Each leaderboard row is tagged with the pairs it takes part in and the two rows of
    a pair meet in one aggregation, so the leaderboard is computed once, not once per side.
    """
    roles = [
        F.struct(F.lit(i).alias("pair"), F.lit(a).alias("base_model"), F.lit(b).alias("other_model"), F.lit(role).alias("role"))
        for i, (a, b) in enumerate(pairs)
        for role in ("base", "other")
    ]
    named = F.when(col("r.role") == "base", col("r.base_model")).otherwise(col("r.other_model"))
    tagged = board.withColumn("r", F.explode(F.array(*roles))).filter(named == col("model_id"))
    sides = [
        F.max(F.when(col("r.role") == role, col(m))).alias(f"{role}_{m}") for role in ("base", "other") for m in _COMPARED
    ]
    return (
        tagged.groupBy(col("r.pair").alias("pair"), col("r.base_model").alias("base_model"), col("r.other_model").alias("other_model"))
        .agg(F.count_distinct("r.role").alias("sides"), *sides)
        .filter(col("sides") == 2)
        .drop("sides")
    )


def budget_deltas(board: DataFrame, a: str, b: str) -> DataFrame:
    """Percentage points gained by model b over model a."""
    return metric_pairs(board, [(a, b)]).select(
        "base_model", "other_model",
        *[((col(f"other_{m}") - col(f"base_{m}")) * F.lit(100.0)).alias(f"{m}_change") for m in _COMPARED],
    )


def alignment_pairs(board: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Gain of each tuned model over its base, and the mean gain on a last row."""
    gains = metric_pairs(board, pairs).select(
        "base_model", "other_model", *[(col(f"other_{m}") - col(f"base_{m}")).alias(f"{m}_gain") for m in _COMPARED]
    )
    means = gains.agg(F.count(F.lit(1)).alias("pairs"), *[F.avg(f"{m}_gain").alias(f"{m}_gain") for m in _COMPARED])
    means = means.filter("pairs > 0").select(
        F.lit("mean").alias("base_model"), F.lit("mean").alias("other_model"), *[f"{m}_gain" for m in _COMPARED]
    )
    return gains.unionByName(means)


def dataset_summary(board: DataFrame, answer: str = "answer_accuracy") -> DataFrame:
    """One row of mean, spread and range over the models of a leaderboard."""
    stats = []
    for name, c in (("answer", answer), ("refusal", "refusal_accuracy"), ("crs", "calibrated_refusal_score")):
        stats += [
            F.avg(c).alias(f"mean_{name}"), F.stddev_pop(c).alias(f"std_{name}"),
            F.min(c).alias(f"min_{name}"), F.max(c).alias(f"max_{name}"),
        ]
    gap = col(answer) - col("refusal_accuracy")
    return board.agg(
        F.count(F.lit(1)).alias("total_models"), *stats, F.avg(gap).alias("mean_gap"),
        F.count_if(gap > 0).alias("models_answer_above_refusal"),
    )


def dataset_top(board: DataFrame, k: int = 3) -> DataFrame:
    return top_k(board.select("model_id", "calibrated_refusal_score"), "calibrated_refusal_score", k)


def cross_dataset_gap(board_a: DataFrame, board_b: DataFrame, metric: str = "calibrated_refusal_score") -> DataFrame:
    """Mean of one leaderboard minus the mean of the other."""
    both = board_a.select(F.lit(True).alias("first"), metric).unionByName(board_b.select(F.lit(False).alias("first"), metric))
    first, second = F.avg(F.when(col("first"), col(metric))), F.avg(F.when(~col("first"), col(metric)))
    return both.agg(first.alias("mean_a"), second.alias("mean_b"), (first - second).alias("difference"))


def detailed_results(results: DataFrame, dataset: str = "single") -> DataFrame:
    """Every leaderboard metric together with the class and intensity breakdowns, long.

    The result rows are counted once per (model, class code, intensity); the three levels
    are grouping sets over that small table.
    """
    names = list(_conditions())
    code = F.regexp_extract(col("ground_truth_label"), _CLASS_CODE, 1)
    base = tally(results.withColumn("code", code), ["model_id", "code", "intensity"], *names)
    t = (
        base.groupingSets([["model_id"], ["model_id", "code"], ["model_id", "intensity"]], "model_id", "code", "intensity")
        .agg(F.grouping("code").alias("no_code"), F.grouping("intensity").alias("no_intensity"), *[F.sum(n).alias(n) for n in names])
    )
    overall = (col("no_code") == 1) & (col("no_intensity") == 1)
    by_code = col("no_code") == 0
    board = _board_columns()
    kept = ("refusal_accuracy", "overall_refusal_rate", "unanswerable_instances")
    wanted = overall | (by_code & (F.length("code") > 0)) | (~by_code & col("intensity").isin(*vocab.INTENSITIES))
    return t.filter(wanted & (overall | (col("unanswerable_instances") > 0))).select(
        F.when(overall, "overall").when(by_code, "class").otherwise("intensity").alias("level"),
        F.when(overall, "all").when(by_code, col("code")).otherwise(col("intensity")).alias("value"),
        "model_id",
        *[(c if n in kept else F.when(overall, c)).alias(n) for n, c in board.items()],
        F.lit(dataset).alias("dataset"),
    )


def summary_table(single: DataFrame, multi: DataFrame) -> DataFrame:
    """Stack the leaderboards of both dataset families; absent metrics are null."""
    return single.withColumn("dataset", F.lit("single")).unionByName(
        multi.withColumn("dataset", F.lit("multi")), allowMissingColumns=True
    )


# --- progress ---------------------------------------------------------------------------


def run_progress(results: DataFrame, samples: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per requested model: finished rows and samples, what remains, and whether the
    number of samples differs from the dataset."""
    spark = results.sparkSession
    total = samples.agg(F.count_distinct("sample_id"))
    done = (
        results.filter(col("model_id").isin(*models))
        .groupBy("model_id")
        .agg(F.count(F.lit(1)).alias("finished"), F.count_distinct("sample_id").alias("distinct_samples"))
    )
    asked = literal_table(spark, ("model_id",), [(m,) for m in models])
    n = F.coalesce("distinct_samples", F.lit(0))
    return asked.join(done, "model_id", "left").select(
        "model_id", F.coalesce("finished", F.lit(0)).alias("finished"), n.alias("distinct_samples"),
        (only_value(total) - n).alias("remaining"), (only_value(total) != n).alias("size_mismatch"),
    )


def missing_models(results: DataFrame, models: Sequence[str]) -> DataFrame:
    asked = literal_table(results.sparkSession, ("model_id",), [(m,) for m in models])
    seen = results.filter(col("model_id").isin(*models)).select("model_id").distinct()
    return asked.join(seen, "model_id", "left_anti")
