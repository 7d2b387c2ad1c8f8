"""Generator and verifier analysis over complete vote groups.

Input is ``voting.complete(voting.align(votes))``. Statistics per verifier or per pair are
aggregated side by side in one pass over the aligned rows and turned into long tables
afterwards, when only a handful of rows are left; the aligned rows are never exploded.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demur import vocab
from demur.functions.columns import col, percent, ratio

_RATE_BAND = 5.0  # percentage points of difference that count as favouring a side


def pass_rate_matrix(aligned: DataFrame, verifiers: Sequence[str] = vocab.VERIFIERS) -> DataFrame:
    """(generator, verifier): votes incl. errors, passes, failures, errors, pass rate in %."""
    counts = []
    for i, _ in enumerate(verifiers):
        result = col("votes")[i]["result"]
        counts += [
            F.count_if(result != "MISSING").alias(f"total_{i}"), F.count_if(result == "PASS").alias(f"pass_{i}"),
            F.count_if(result == "FAIL").alias(f"fail_{i}"), F.count_if(result == "ERROR").alias(f"error_{i}"),
        ]
    wide = aligned.groupBy("generator_model").agg(*counts)
    long = F.inline(F.array(*[
        F.struct(
            F.lit(v).alias("verifier_model"), col(f"total_{i}").alias("total"), col(f"pass_{i}").alias("pass"),
            col(f"fail_{i}").alias("fail"), col(f"error_{i}").alias("error"),
        )
        for i, v in enumerate(verifiers)
    ]))
    return wide.select("generator_model", long).filter("total > 0").withColumn("pass_rate", percent("pass", "total"))


def _own() -> Column:
    return col("generator_model") == col("verifier_model")


def _sides(matrix: DataFrame) -> DataFrame:
    def total(cond: Column, c: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, col(c))), F.lit(0))

    return matrix.groupBy("generator_model").agg(
        total(_own(), "pass").alias("self_pass"), total(_own(), "total").alias("self_total"),
        total(~_own(), "pass").alias("cross_pass"), total(~_own(), "total").alias("cross_total"),
    )


def self_vs_cross(matrix: DataFrame) -> DataFrame:
    """Pooled pass rates by the generator's own verifier and by the others, in %."""
    bias = col("self_pass_rate") - col("cross_pass_rate")
    return (
        _sides(matrix)
        .select(
            "generator_model", percent("self_pass", "self_total").alias("self_pass_rate"),
            percent("cross_pass", "cross_total").alias("cross_pass_rate"), "self_total", "cross_total",
        )
        .withColumn("self_bias", bias)
        .withColumn("interpretation", F.when(bias > _RATE_BAND, "self_favorable").when(bias < -_RATE_BAND, "cross_favorable").otherwise("neutral"))
    )


def verifier_bias(matrix: DataFrame) -> DataFrame:
    """Per verifier, as fractions: rate on its own generator minus the unweighted mean of
    its rates on the others. Needs both sides."""
    rate = ratio("pass", "total")
    return (
        matrix.filter("total > 0").groupBy("verifier_model")
        .agg(F.avg(F.when(_own(), rate)).alias("own_pass_rate"), F.avg(F.when(~_own(), rate)).alias("other_pass_rate"))
        .filter("own_pass_rate IS NOT NULL AND other_pass_rate IS NOT NULL")
        .withColumn("bias_score", col("own_pass_rate") - col("other_pass_rate"))
    )


def bias_ranking(bias: DataFrame) -> DataFrame:
    return bias.select(
        "verifier_model", "bias_score", F.abs("bias_score").alias("bias_magnitude"),
        F.when(col("bias_score") > 0, "self_favorable").otherwise("other_favorable").alias("bias_direction"),
    ).orderBy(F.desc("bias_magnitude"), "verifier_model")


def _pair_counts(aligned: DataFrame, verifiers: Sequence[str]) -> DataFrame:
    """One row per verifier pair; all pairs are counted side by side in one pass."""
    pairs = list(combinations(range(len(verifiers)), 2))
    aggs = []
    for i, j in pairs:
        a, b = col("votes")[i]["result"], col("votes")[j]["result"]
        aggs += [
            F.count_if((a == b) & a.isin("PASS", "FAIL")).alias(f"agree_{i}_{j}"),
            F.count_if((a == "PASS") & (b == "FAIL")).alias(f"pf_{i}_{j}"),
            F.count_if((a == "FAIL") & (b == "PASS")).alias(f"fp_{i}_{j}"),
        ]
    structs = [
        F.struct(
            F.lit(f"{verifiers[i]}_{verifiers[j]}").alias("verifier_pair"), col(f"agree_{i}_{j}").alias("agree"),
            col(f"pf_{i}_{j}").alias("pass_vs_fail"), col(f"fp_{i}_{j}").alias("fail_vs_pass"),
        )
        for i, j in pairs
    ]
    return aligned.agg(*aggs).select(F.inline(F.array(*structs)))


def pairwise_agreement(aligned: DataFrame, verifiers: Sequence[str] = vocab.VERIFIERS) -> DataFrame:
    """Agreement on PASS/FAIL per verifier pair; errors are not compared."""
    t = _pair_counts(aligned, verifiers).withColumn("disagree", col("pass_vs_fail") + col("fail_vs_pass"))
    rate = percent("agree", "total_comparisons")
    return (
        t.withColumn("total_comparisons", col("agree") + col("disagree")).filter("total_comparisons > 0")
        .select(
            "verifier_pair", "agree", "disagree", "total_comparisons", rate.alias("agreement_rate"),
            F.when(rate > 80, "high").when(rate > 60, "medium").otherwise("low").alias("agreement_strength"),
        )
    )


def disagreement_patterns(aligned: DataFrame, verifiers: Sequence[str] = vocab.VERIFIERS) -> DataFrame:
    kinds = F.inline(F.array(
        F.struct(F.lit("PASS_vs_FAIL").alias("pattern"), col("pass_vs_fail").alias("n")),
        F.struct(F.lit("FAIL_vs_PASS").alias("pattern"), col("fail_vs_pass").alias("n")),
    ))
    return _pair_counts(aligned, verifiers).select("verifier_pair", kinds).filter("n > 0")


def agreement_extremes(pairs: DataFrame, min_n: int = 10) -> DataFrame:
    """Pairs with enough comparisons that agree above 80% or below 50%."""
    rate = col("agreement_rate")
    return (
        pairs.filter(col("total_comparisons") >= min_n)
        .withColumn("kind", F.when(rate > 80, "high_agreement").when(rate < 50, "high_disagreement"))
        .filter("kind IS NOT NULL")
        .select("kind", "verifier_pair", "agreement_rate", "total_comparisons")
    )


def effectiveness(aligned: DataFrame) -> DataFrame:
    """Per generator by class, by intensity and by lever: attempts and unanimous passes."""
    dims = ("perturbation_class", "intensity", "lever_selected")
    base = aligned.groupBy("generator_model", *dims).agg(F.count(F.lit(1)).alias("n"), F.count_if("has_unanimous_pass").alias("ok"))
    sets = [["generator_model", d] for d in dims]
    t = base.groupingSets(sets, "generator_model", *dims).agg(F.grouping_id().alias("gid"), F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    names = {0b011: ("class", dims[0]), 0b101: ("intensity", dims[1]), 0b110: ("lever", dims[2])}
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for gid, (label, d) in names.items():
        dimension = F.when(col("gid") == gid, label).otherwise(dimension)
        value = F.when(col("gid") == gid, col(d)).otherwise(value)
    return t.select(
        "generator_model", dimension.alias("dimension"), value.alias("value"), col("n").alias("total_attempts"),
        col("ok").alias("successful_perturbations"), percent("ok", "n").alias("success_rate"),
    )


def specialisation(table: DataFrame, min_n: int = 5) -> DataFrame:
    """Per category the generator with the best success rate and its lead, where at least
    two generators have enough attempts. Equal rates go to the first name."""
    group = Window.partitionBy("dimension", "value")
    ranked = group.orderBy(F.desc("success_rate"), "generator_model")
    return (
        table.filter(col("total_attempts") >= min_n)
        .withColumns({
            "position": F.row_number().over(ranked), "runner_up": F.lead("success_rate").over(ranked),
            "generators": F.count(F.lit(1)).over(group),
        })
        .filter("position = 1 AND generators > 1 AND success_rate > 0")
        .select(
            "dimension", "value", col("generator_model").alias("best_generator"), col("success_rate").alias("best_success_rate"),
            (col("success_rate") - col("runner_up")).alias("performance_gap"),
        )
    )


def filtering_efficiency(aligned: DataFrame) -> DataFrame:
    """Unanimous passes among the complete groups, whatever mode filters the dataset."""
    return (
        aligned.groupBy("generator_model")
        .agg(F.count(F.lit(1)).alias("total_generated"), F.count_if("has_unanimous_pass").alias("passed_filtering"))
        .withColumn("filtering_efficiency", percent("passed_filtering", "total_generated"))
    )


def generator_comparison(efficiency: DataFrame) -> DataFrame:
    return efficiency.select(
        "generator_model", col("total_generated").alias("total_perturbations_generated"),
        col("passed_filtering").alias("high_quality_examples"), col("filtering_efficiency").alias("success_rate"),
    )


_QUALITY = {
    "lever_correctness": "lever_correctly_implemented",
    "intensity_correctness": "intensity_correctly_achieved",
    "uncertainty_induction": "uncertainty_successfully_induced",
}


def quality_metrics(aligned: DataFrame, verifiers: Sequence[str] = vocab.VERIFIERS) -> DataFrame:
    """Over the PASS votes, how often each quality flag is true; a null flag is false."""
    slots = range(len(verifiers))
    passed = [col("votes")[i]["result"] == "PASS" for i in slots]
    n = sum((F.count_if(p) for p in passed), F.lit(0).cast("long"))
    aggs = [n.alias("sample_size")]
    for metric, field in _QUALITY.items():
        good = sum((F.count_if(passed[i] & col("votes")[i][field]) for i in slots), F.lit(0).cast("long"))
        aggs.append(good.alias(metric))
    t = aligned.groupBy("generator_model").agg(*aggs)
    return t.filter("sample_size > 0").select("generator_model", *[percent(m, "sample_size").alias(m) for m in _QUALITY], "sample_size")


def generator_ranking(matrix: DataFrame) -> DataFrame:
    """Pass rate over own and other verifiers together, best first."""
    n = col("self_total") + col("cross_total")
    return (
        _sides(matrix).filter("self_total > 0")
        .select("generator_model", percent(col("self_pass") + col("cross_pass"), n).alias("overall_pass_rate"), n.alias("total_evaluations"))
        .orderBy(F.desc("overall_pass_rate"), "generator_model")
    )


def top_pairs(matrix: DataFrame, min_n: int = 10, k: int = 10) -> DataFrame:
    return (
        matrix.filter(col("total") >= min_n)
        .select("generator_model", "verifier_model", "pass_rate", col("total").alias("sample_size"), _own().alias("is_self_verification"))
        .orderBy(F.desc("pass_rate"), "generator_model", "verifier_model")
        .limit(k)
    )


def verifier_reliability(matrix: DataFrame) -> DataFrame:
    t = matrix.groupBy("verifier_model").agg(*[F.sum(c).alias(c) for c in ("total", "pass", "fail", "error")])
    return t.select(
        "verifier_model", col("total").alias("total_evaluations"), percent("pass", "total").alias("pass_rate"),
        percent("fail", "total").alias("fail_rate"), percent("error", "total").alias("error_rate"),
        percent(col("pass") + col("fail"), "total").alias("reliability_score"),
    )


def category_distribution(unified: DataFrame) -> DataFrame:
    """Rows of the final dataset by class, intensity and lever, long format. The number of
    distinct classes (levers) is the number of rows of that dimension."""
    dims = ("perturbation_class", "intensity", "lever_selected")
    known = unified.select(*[F.coalesce(col(d), F.lit("unknown")).alias(d) for d in dims])
    base = known.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    t = base.groupingSets([[d] for d in dims], *dims).agg(F.grouping_id().alias("gid"), F.sum("n").alias("n"))
    return t.select(
        F.when(col("gid") == 0b011, "class").when(col("gid") == 0b101, "intensity").otherwise("lever").alias("dimension"),
        F.coalesce(*dims).alias("value"), "n",
    ).withColumn("distinct_values", F.count(F.lit(1)).over(Window.partitionBy("dimension")))


# --- report tables ---------------------------------------------------------------------


def effectiveness_table(matrix: DataFrame, verifiers: Sequence[str] = vocab.VERIFIERS) -> DataFrame:
    """Generators as rows, verifiers as columns, absent pairs 0, and the row mean."""
    wide = matrix.groupBy("generator_model").pivot("verifier_model", list(verifiers)).agg(F.first("pass_rate"))
    rates = [F.coalesce(col(v), F.lit(0.0)) for v in verifiers]
    mean = sum(rates[1:], rates[0]) / len(verifiers)
    return wide.select("generator_model", *[r.alias(v) for r, v in zip(rates, verifiers)], mean.alias("average"))


def specialisation_table(special: DataFrame, min_gap: float = 5.0) -> DataFrame:
    return special.filter(col("performance_gap") > min_gap)


def printable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rates as '12.3%' text, for the exported tables only."""
    return df.withColumns({c: F.format_string("%.1f%%", col(c)) for c in columns})


def matrix_self_bias(matrix: DataFrame) -> DataFrame:
    """Per generator: rate by its own verifier minus the mean of the others, and the mean."""
    t = (
        matrix.groupBy("generator_model")
        .agg(F.avg(F.when(_own(), col("pass_rate"))).alias("self_rate"), F.avg(F.when(~_own(), col("pass_rate"))).alias("other_rate"))
        .filter("self_rate IS NOT NULL AND other_rate IS NOT NULL")
        .select("generator_model", (col("self_rate") - col("other_rate")).alias("self_bias"))
    )
    return t.groupingSets([["generator_model"], []], "generator_model").agg(F.avg("self_bias").alias("self_bias")).select(
        F.coalesce("generator_model", F.lit("mean")).alias("generator_model"), "self_bias"
    ).filter("self_bias IS NOT NULL")


def class_mastery(aligned: DataFrame) -> DataFrame:
    """Share of PASS among all votes per perturbation class."""
    t = aligned.groupBy("perturbation_class").agg(
        F.sum("pass_votes").alias("passed"), F.sum("responding").alias("evaluations"), F.count_if("has_unanimous_pass").alias("unanimous"),
        F.count(F.lit(1)).alias("contents"),
    )
    return t.select(
        "perturbation_class", percent("passed", "evaluations").alias("pass_rate"), percent("unanimous", "contents").alias("unanimous_rate"),
        "evaluations",
    )


def verification_coverage(aligned: DataFrame) -> DataFrame:
    """Over all groups: share with every verifier, and the number of votes."""
    t = aligned.agg(F.count(F.lit(1)).alias("contents"), F.count_if("is_complete").alias("complete"), F.sum("responding").alias("total_evaluations"))
    return t.select("contents", "complete", ratio("complete", "contents").alias("coverage"), F.coalesce("total_evaluations", F.lit(0)).alias("total_evaluations"))


# --- run statistics ------------------------------------------------------------------------


def generation_stats(perturbations: DataFrame) -> DataFrame:
    """Attempts and successes overall and per class and intensity ('all' rows)."""
    t = perturbations.groupBy("perturbation_class", "intensity").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("generation_successful").alias("successes")
    )
    t = t.groupingSets([[], ["perturbation_class", "intensity"]], "perturbation_class", "intensity").agg(
        F.sum("attempts").alias("attempts"), F.sum("successes").alias("successes")
    )
    return t.filter("attempts IS NOT NULL").select(
        F.coalesce("perturbation_class", F.lit("all")).alias("perturbation_class"), F.coalesce("intensity", F.lit("all")).alias("intensity"),
        "attempts", "successes", (col("attempts") - col("successes")).alias("failures"), percent("successes", "attempts").alias("success_rate"),
    )


def verification_stats(votes: DataFrame) -> DataFrame:
    """Per verifier, overall and per class and intensity: totals and three rates in %."""
    ok = F.coalesce(col("verification_successful"), F.lit(False))
    t = votes.groupBy("verifier_model", "perturbation_class", "intensity").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("generation_successful").alias("generated"), F.count_if(ok).alias("verified"),
        F.count_if(ok & (col("verification_result") == "PASS")).alias("passed"),
    )
    t = t.groupingSets(
        [["verifier_model"], ["verifier_model", "perturbation_class", "intensity"]], "verifier_model", "perturbation_class", "intensity"
    ).agg(*[F.sum(c).alias(c) for c in ("total", "generated", "verified", "passed")])
    return t.select(
        "verifier_model", F.coalesce("perturbation_class", F.lit("all")).alias("perturbation_class"),
        F.coalesce("intensity", F.lit("all")).alias("intensity"), "total", "generated", "verified", "passed",
        percent("generated", "total").alias("generation_rate"), percent("verified", "total").alias("verification_rate"),
        percent("passed", "verified").alias("pass_rate"),
    )
