"""All metric and agreement tables of a run, computed from one pass over the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from demur.operators import analysis, metrics, multidoc, voting
from demur.plans.shared import discard, materialise
from demur.sources import sinks


@dataclass(frozen=True)
class Comparisons:
    """Which models of a run are compared by name. The table of a field that is not given is left out."""

    frontier: Sequence[str] = ()
    #: billions of parameters
    sizes: Mapping[str, int] = field(default_factory=dict)
    #: without and with a reasoning budget
    budget: tuple[str, str] | None = None
    #: base and tuned models
    tuned: Sequence[tuple[str, str]] = ()


def _compared(board: DataFrame, compare: Comparisons) -> dict[str, DataFrame]:
    tables = {}
    if compare.sizes:
        tables["scaling"] = metrics.scaling_table(board, compare.sizes)
    if compare.budget:
        tables["budget"] = metrics.budget_deltas(board, *compare.budget)
    if compare.tuned:
        tables["alignment"] = metrics.alignment_pairs(board, compare.tuned)
    return tables


def metric_tables(results: DataFrame, compare: Comparisons = Comparisons()) -> dict[str, DataFrame]:
    """Single-document tables. Pass ``condense(results)`` to read the results once."""
    board = metrics.leaderboard(results)
    tables = {
        "leaderboard": board,
        "evaluator_metrics": metrics.evaluator_metrics(results),
        "confusion": metrics.confusion_matrix(results),
        "confusion_by_intensity": metrics.confusion_matrix(results, by_intensity=True),
        "kappa": metrics.cohen_kappa(results),
        "by_class": metrics.refusal_by_class(results),
        "by_intensity": metrics.refusal_by_intensity(results),
        "coverage": metrics.coverage_matrix(results),
        "coverage_by_class": metrics.coverage_matrix(results, by="class"),
        "detailed": metrics.detailed_results(results),
        "summary": metrics.dataset_summary(board),
    } | _compared(board, compare)
    if compare.frontier:
        tables["frontier"] = metrics.frontier_leaderboard(results, compare.frontier)
    if "confidence_level" in results.columns:
        tables |= {
            "calibration": metrics.calibration_error(results),
            "calibration_parts": metrics.calibration_decomposed(results),
            "reliability": metrics.reliability_bins(results),
        }
    return tables


def multidoc_tables(results: DataFrame) -> dict[str, DataFrame]:
    breakdowns = multidoc.breakdowns(results)
    return {
        "metrics": multidoc.hybrid_score(multidoc.multidoc_metrics(results)),
        "frontier": multidoc.multidoc_frontier(results),
        "breakdowns": breakdowns,
        "top_domains": multidoc.top_domains(breakdowns),
        "distribution": multidoc.response_distribution(results),
        "quality": multidoc.answer_quality(results),
        "domains": multidoc.domain_performance(results),
    }


def agreement_tables(aligned: DataFrame) -> dict[str, DataFrame]:
    full = voting.complete(aligned)
    matrix = analysis.pass_rate_matrix(full)
    pairs = analysis.pairwise_agreement(full)
    effect = analysis.effectiveness(full)
    special = analysis.specialisation(effect)
    bias = analysis.verifier_bias(matrix)
    return {
        "funnel": voting.agreement_funnel(aligned),
        "pass_rates": matrix,
        "table1_effectiveness": analysis.effectiveness_table(matrix),
        "table2_self_vs_cross": analysis.self_vs_cross(matrix),
        "table3_specialisation": analysis.specialisation_table(special),
        "table4_efficiency": analysis.filtering_efficiency(full),
        "bias": analysis.bias_ranking(bias),
        "pairwise": pairs,
        "extremes": analysis.agreement_extremes(pairs),
        "disagreements": analysis.disagreement_patterns(full),
        "effectiveness": effect,
        "quality": analysis.quality_metrics(full),
        "generators": analysis.generator_ranking(matrix),
        "top_pairs": analysis.top_pairs(matrix),
        "verifiers": analysis.verifier_reliability(matrix),
        "class_mastery": analysis.class_mastery(full),
        "coverage": analysis.verification_coverage(aligned),
    }


def cross_dataset_tables(single: DataFrame, multi: DataFrame, k: int = 3) -> dict[str, DataFrame]:
    """Both dataset families side by side, from the leaderboard of each (a row per model)."""
    return {
        "leaderboards": metrics.summary_table(single, multi),
        "gap": metrics.cross_dataset_gap(single, multi),
        "summary_single": metrics.dataset_summary(single),
        "summary_multi": metrics.dataset_summary(multi, answer="answer_quality_score"),
        "top_single": metrics.dataset_top(single, k),
        "top_multi": metrics.dataset_top(multi, k),
    }


def write_metric_report(results: DataFrame, path: str, compare: Comparisons = Comparisons()) -> None:
    """Every single-document table as CSV, from counts taken in one pass over the results."""
    counts = materialise(metrics.condense(results), "counts")
    for name, table in metric_tables(counts, compare).items():
        sinks.write_csv(table, f"{path}/{name}")
    discard(counts)


def write_agreement_report(votes: DataFrame, path: str) -> None:
    """Every agreement table as CSV, from votes aligned once."""
    aligned = materialise(voting.align(votes), "aligned")
    for name, table in agreement_tables(aligned).items():
        sinks.write_csv(table, f"{path}/{name}")
    discard(aligned)


def write_multidoc_report(results: DataFrame, path: str) -> None:
    """Every multi-document table as CSV, and the class, intensity and coverage tables of the
    same results in single-document form."""
    single = multidoc.as_single(results)
    tables = multidoc_tables(results) | {
        "by_class": metrics.refusal_by_class(single), "by_intensity": metrics.refusal_by_intensity(single), "coverage": metrics.coverage_matrix(single),
    }
    for name, table in tables.items():
        sinks.write_csv(table, f"{path}/{name}")


def write_cross_dataset_report(single: DataFrame, multi: DataFrame, path: str, k: int = 3) -> None:
    """The tables that compare single-document with multi-document results, as CSV; each result table is read once."""
    boards = [materialise(metrics.leaderboard(single), "board-single"), materialise(multidoc.multidoc_frontier(multi), "board-multi")]
    for name, table in cross_dataset_tables(*boards, k).items():
        sinks.write_csv(table, f"{path}/{name}")
    for board in boards:
        discard(board)
