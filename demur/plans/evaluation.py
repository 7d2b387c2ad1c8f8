"""Evaluating models: what to ask next, and from replies to results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.functions.columns import col
from demur.operators import matching, parsing, prompts, records


def next_answers(samples: DataFrame, results: DataFrame, models: Sequence[str], family: str = "single") -> DataFrame:
    """Requests for every (sample, model) without a result yet."""
    ready = records.evaluation_gate(samples) if family == "single" else samples
    return prompts.answer_requests(ready, models, family, pending=matching.remaining(ready, results, models))


def next_judgements(samples: DataFrame, answers: DataFrame, family: str = "single") -> DataFrame:
    """Judge requests for the answers that arrived without an error.

    ``answers``: sample_id, model_id, response, error.
    """
    came = answers.filter(col("error").isNull())
    if family == "single":
        references = F.when(records.is_answerable(), col("references"))
        rows = came.join(samples, "sample_id").withColumns({"model_raw_output": col("response"), "references": references})
    else:
        rows = came.join(samples, "sample_id").withColumn("model_answer", col("response"))
    return prompts.judge_requests(rows, family)


def results(judged: DataFrame, family: str = "single") -> DataFrame:
    """Result rows from judged answers: response (of the judge), error, and the labels."""
    if family == "single":
        return parsing.dual_outcome(parsing.parse_judgement(judged), "single")
    return parsing.dual_outcome(parsing.parse_comprehensive(judged), "multi")
