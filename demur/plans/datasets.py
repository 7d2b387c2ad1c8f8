"""From verification logs to a published dataset: the four builders.

stratified  align, keep agreed contents, sample per stratum, fetch texts
multi       the same for questions with several passages, patches applied
common      align, keep agreed contents, keep tasks agreed in every generator
reference   align by task fields, keep by the looser rule, join the base questions
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur import vocab
from demur.functions.columns import col, value_of
from demur.functions.keys import generator_short_name, multi_content_fields, stratum_key, unique_key
from demur.operators import passages, sampling, unified, voting
from demur.plans.shared import join_way, materialise
from demur.sources import sinks

# the reference builder matches rewrites by what was asked, not by the rewritten text
REFERENCE_FIELDS = ("source_qid", "perturbation_class", "intensity", "lever_selected", "source_line")


def stratified_dataset(
    votes: DataFrame, mode: str = "unanimous", per_stratum: int = vocab.PER_STRATUM, target: int = vocab.PER_GENERATOR, seed: int = vocab.SEED
) -> DataFrame:
    """Agreed rewrites, evenly over the 18 strata of every generator.

    The sample is decided on ids, hashes and votes. The agreed contents are used three
    times (quota, fill, the final pick) and therefore written once, and so is the sample;
    where it turns out small, adaptive execution sends it to the texts.
    """
    kept = materialise(voting.generation_success_filter(voting.agreed(voting.align(votes), mode)), "kept")
    sample = materialise(sampling.stratified_sample(kept, per_stratum=per_stratum, target=target, seed=seed), "sample")
    return unified.unified_record(votes, sample, mode)


def multi_dataset(
    votes: DataFrame, mode: str = "unanimous", per_stratum: int = vocab.PER_STRATUM, target: int = vocab.PER_GENERATOR, seed: int = vocab.SEED
) -> DataFrame:
    """Multi-document form of ``stratified_dataset``, from ``read_multi_verifications``.

    Contents are equal if question, patches, class, intensity and lever are. The patches are
    applied to the original record, which keeps its own fields; what was done to it is in
    ``perturbation_metadata`` and ``stratified_metadata``, as ``records.flatten`` reads them.
    """
    content = multi_content_fields()
    kept = materialise(voting.generation_success_filter(voting.agreed(voting.align(votes, content), mode)), "kept")
    sample = materialise(sampling.stratified_sample(kept, per_stratum=per_stratum, target=target, seed=seed), "sample")
    rows = unique_key(materialise(voting.representatives(votes, sample, content), "records"), "multi")
    short = generator_short_name("generator_model")
    full = {name: long for long, name in vocab.GENERATOR_SHORT.items()}
    metadata = F.struct("perturbation_class", "intensity", "lever_selected", "generation_successful", "source_qid", "expected_rag_behavior")
    place = F.struct(
        short.alias("generator_model"), F.coalesce(value_of(full, "generator_model"), col("generator_model")).alias("generator_model_full"),
        F.concat(F.lit("dataset_"), short).alias("source_folder"), "unique_id", stratum_key().alias("stratum_key"), F.lit(mode).alias("filtering_mode"),
    )
    flat = rows.select(
        "original_data.*", "perturbed_query", col("perturbed_signal_passages").alias("signal_patches"), col("perturbed_noise_passages").alias("noise_patches"),
        "passage_mapping.signal_indices", "passage_mapping.noise_indices", "parsing_successful",
        metadata.alias("perturbation_metadata"), place.alias("stratified_metadata"),
    )
    return passages.apply_patches(flat).drop("perturbed_query", "signal_patches", "noise_patches", "signal_indices", "noise_indices", "parsing_successful")


def common_dataset(votes: DataFrame, mode: str = "unanimous", n: int | None = None, seed: int = vocab.SEED) -> DataFrame:
    """The same tasks from every generator, optionally n of them."""
    kept = materialise(voting.agreed(voting.align(votes), mode), "kept")
    tasks = sampling.task_sample(materialise(voting.common_tasks(votes, kept), "common"), n, seed)
    chosen = materialise(
        kept.join(tasks.select("generator_model", "content_key"), ["generator_model", "content_key"], "left_semi"), "chosen"
    )
    return unified.unified_record(votes, chosen, mode, "common_tasks")


def reference_dataset(votes: DataFrame, originals: DataFrame, mode: str = "all_agree", verifiers: tuple[str, ...] = vocab.VERIFIERS) -> DataFrame:
    """Agreed rewrites put back into the form of the base dataset.

    Every input file has to have voted. Rewrites without a base question are left out;
    ``join_original`` on its own shows them.
    """
    aligned = voting.complete(voting.align(votes, REFERENCE_FIELDS, verifiers))
    kept = voting.valid_vote_filter(aligned, mode)
    rows = voting.representatives(votes, kept, REFERENCE_FIELDS, verifiers)
    found = unified.join_original(rows, originals.withColumnRenamed("line_no", "_line"), "_line").filter("has_original")
    if "implementation_reasoning" not in found.columns:
        found = found.withColumn("implementation_reasoning", F.lit(None).cast("string"))
    label = col("final_ground_truth_label") if "final_ground_truth_label" in found.columns else F.lit(None).cast("string")
    return unique_key(materialise(found, "records"), "reference").withColumns({
        "query": col("perturbed_query"), "ground_truth_label": F.coalesce(label, F.lit("")), "agreement_mode_used": F.lit(mode),
    })


def write_filtered_votes(votes: DataFrame, tasks: DataFrame, path: str) -> None:
    """The votes that count on selected contents (aligned rows), one folder per (generator, verifier)."""
    vote = F.explode(F.filter("votes", lambda v: v["result"] != "MISSING"))
    wanted = tasks.select("generator_model", "content_key", vote.alias("v"))
    # an aligned row knows which line of which verifier counts
    wanted = wanted.select("generator_model", "content_key", col("v.verifier_model").alias("verifier_model"), col("v.line_no").alias("line_no"))
    sinks.write_by_pair(voting.annotate(votes).join(wanted.hint(join_way(tasks)), wanted.columns, "left_semi"), path)


def write_dataset(dataset: DataFrame, path: str, mode: str = "unanimous", seed: int = vocab.SEED) -> None:
    """The dataset as JSON lines, and its reports computed from what was written."""
    sinks.write_jsonl(unified.stamp(dataset), f"{path}/dataset")
    written = dataset.sparkSession.read.schema("generator_model string, perturbation_class string, intensity string").json(f"{path}/dataset")
    report = sampling.stratification_report(written)
    tables = {
        "metadata": sampling.run_metadata(written, mode, seed),
        "strata": report,
        "summary": sampling.stratification_summary(report),
        "generators": sampling.stratification_models(written),
        "crosstab": sampling.sample_crosstab(written),
    }
    for name, table in tables.items():
        sinks.write_jsonl(table, f"{path}/{name}")

