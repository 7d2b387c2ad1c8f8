"""Generating and verifying rewrites: what to ask next, and from replies to appended logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur import vocab
from demur.functions.columns import col
from demur.operators import matching, parsing, prompts


def next_generations(
    instances: DataFrame, log: DataFrame, generator: str, family: str = "single", target: int | None = None, ident: str = "qid"
) -> DataFrame:
    """Requests to one generator for every cell it has not rewritten yet.

    ``log``: its and others' rewrites (generator_model, source_qid, class, intensity,
    generation_successful). With a ``target``, only for as many instances as that takes.
    """
    own = log.filter(col("generator_model") == generator)
    cells = matching.missing_cells(instances, own, target, ident)
    requests = prompts.generator_requests(instances, family, cells=cells, generator=generator)
    return requests.withColumn("generator_model", F.lit(generator))


def generation_log(requests: DataFrame, replies: DataFrame, schema: str) -> DataFrame:
    """Rewrites from the requests that were answered, one per request; to be appended to the log."""
    return parsing.generation_result(matching.attach(requests, replies), schema)


def next_verifications(rewrites: DataFrame, log: DataFrame, verifiers: Sequence[str] = vocab.VERIFIERS, family: str = "single") -> DataFrame:
    """Requests to every verifier for the rewrites it has not voted on yet (whole-text key)."""
    left = matching.remaining_by_verifier(rewrites, log, verifiers, family)
    return prompts.verifier_requests(left, verifiers, family, pending="pending")


def verification_log(requests: DataFrame, replies: DataFrame, schema: str) -> DataFrame:
    """Votes from the requests that were answered, one per request; to be appended to the log."""
    return parsing.verification_result(matching.attach(requests, replies), schema)
