"""Output records of the dataset builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demur import vocab
from demur.functions.columns import col, value_of
from demur.functions.keys import CONTENT_FIELDS, content_key, generator_short_name, stratum_key, task_id, unique_key
from demur.operators.sampling import dedupe_last
from demur.plans.shared import join_way, materialise

_OPTIONAL = {
    "original_answers": "array<string>", "expected_rag_behavior": "string", "parsing_successful": "boolean",
    "implementation_reasoning": "string", "generation_successful": "boolean",
}


def _with_optional(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in df.columns})


def verification_results() -> Column:
    """Map verifier -> verdict; a failed verifier keeps null verdict fields."""
    def entry(v: Column) -> Column:
        ok = v["result"] != "ERROR"
        known = [
            F.when(ok, v[f]).alias(f)
            for f in (
                "lever_correctly_implemented", "intensity_correctly_achieved", "uncertainty_successfully_induced",
                "answer_constraint_satisfied", "final_ground_truth_label",
            )
        ]
        return F.struct(
            v["verifier_model"],
            F.struct(
                ok.alias("verification_successful"), F.when(ok, v["result"]).alias("verification_result"), *known,
                value_of(vocab.VERIFIER_IDS, v["verifier_model"]).alias("verifier_model_full"),
            ),
        )

    return F.map_from_entries(F.transform(F.filter("votes", lambda v: v["result"] != "MISSING"), entry))


def agreement_analysis() -> Column:
    valid = col("pass_votes") + col("fail_votes")
    agreement = F.map_from_entries(F.transform("votes", lambda v: F.struct(v["verifier_model"], F.struct(v["result"].alias("result")))))
    return F.struct(
        agreement.alias("verifier_agreement"),
        F.struct(
            valid.alias("total_valid_verifications"), col("pass_votes"), col("fail_votes"),
            ((valid > 0) & (col("pass_votes") == valid)).alias("unanimous_pass"), (col("pass_votes") > valid / 2).alias("majority_pass"),
        ).alias("agreement_statistics"),
    )


def unified_record(
    votes: DataFrame, kept: DataFrame, mode: str, strategy: str = "stratified",
    content: Sequence[str | Column] = CONTENT_FIELDS, verifiers: Sequence[str] = vocab.VERIFIERS,
) -> DataFrame:
    """One flat record per kept content, with the texts of its first verifier's record.

    ``kept`` holds complete groups only, so just the first verifier's file is joined, on
    (content, line), and every text is moved once.
    """
    first = col("votes")[0]
    wanted = kept.withColumn("line_no", first["line_no"]).drop("source_qid", "perturbation_class", "intensity", "lever_selected")
    records = _with_optional(votes.filter(col("verifier_model") == verifiers[0])).withColumn("content_key", content_key(content))
    full = {short: name for name, short in vocab.GENERATOR_SHORT.items()}
    folder = {vocab.GENERATOR_SHORT[name]: f for f, name in vocab.GENERATOR_FOLDERS.items()}
    joined = records.drop("verifier_ord").join(wanted.hint(join_way(kept)), ["generator_model", "content_key", "line_no"])
    short = generator_short_name("generator_model")
    # the key reads its rows twice: written, so that the texts are fetched once
    joined = materialise(joined.withColumn("task_id", task_id()), "records")
    keyed = unique_key(joined, "stratified" if strategy == "stratified" else "task")
    return keyed.select(
        "unique_id", (F.lit("stratified_no_task_matching") if strategy == "stratified" else col("task_id")).alias("task_id"),
        "source_qid", short.alias("generator_model"), F.coalesce(value_of(full, "generator_model"), col("generator_model")).alias("generator_model_full"),
        F.coalesce(value_of(folder, short), F.concat(F.lit("dataset_"), short)).alias("source_folder"),
        F.lit(mode).alias("filtering_mode"), F.lit(strategy).alias("sampling_strategy"),
        "original_query", "original_context", "original_answers", "perturbation_class", "intensity", "expected_rag_behavior",
        "perturbed_query", "perturbed_context", "lever_selected", "generation_successful", "parsing_successful", "implementation_reasoning",
        verification_results().alias("verification_results"), agreement_analysis().alias("agreement_analysis"),
        F.lit(len(verifiers)).alias("total_verifiers"), F.lit("content_based_within_folder").alias("content_matching_strategy"),
        "content_key", stratum_key().alias("stratum_key"),
    )


def stamp(df: DataFrame) -> DataFrame:
    """Provenance time, added when a dataset is written."""
    return df.withColumn("formatted_timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def replace_gold_doc(perturbed: str | Column = "perturbed_context", docs: str | Column = "retrieved_docs") -> Column:
    """The rewritten passage in place of the first retrieved document."""
    rest = F.when(F.size(col(docs)) > 1, F.slice(col(docs), F.lit(2), F.size(col(docs)) - 1))
    return F.concat(F.array(F.coalesce(col(perturbed), F.lit(""))), F.coalesce(rest, F.array().cast("array<string>")))


def join_original(df: DataFrame, originals: DataFrame, seq: str = "line_no") -> DataFrame:
    """Attach the base question by qid; ``has_original`` tells misses apart.

    On a repeated qid the last line wins, an empty qid is ignored. Both sides are dealt out
    for the join itself, by the qid and its hash: the partitions that the deduplication
    leaves are not reused, as adaptive execution splits a question with very many rewrites
    only where both sides come straight from a shuffle. The base is never gathered on the
    driver: its computed size is not known to the planner.
    """
    base = dedupe_last(originals.filter(F.length("qid") > 0), ["qid"], seq).drop(seq)
    fields = [col(c).alias(f"original_{c}" if c in df.columns else c) for c in base.columns]
    right = base.select(*fields, F.xxhash64("qid").alias("_right"), F.lit(True).alias("has_original")).hint("merge")
    left = df.withColumn("_left", F.xxhash64("source_qid"))
    joined = left.join(right, (left["source_qid"] == right["qid"]) & (left["_left"] == right["_right"]), "left").drop("_left", "_right")
    return joined.withColumns({
        "has_original": F.coalesce("has_original", F.lit(False)),
        "retrieved_docs": F.when(col("has_original"), replace_gold_doc()),
    })
