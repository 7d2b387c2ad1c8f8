"""Aligning verifier votes and filtering by agreement.

``align`` puts the votes on one rewritten content side by side with a single hash
aggregation. Each vote is packed into one long - line number in the high bits, outcome
and quality flags in the low ones - so that "last line wins" is a plain ``max``. Buffers
stay primitive, the aggregation combines before the shuffle, any number of repeated
votes on one content collapse inside the map tasks, and no passage text is shuffled: the
group key is the md5 of the content. Texts are fetched afterwards for the rows that
survive the filters (``representatives``).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demur import vocab
from demur.functions.columns import col, only_value, percent, value_of
from demur.functions.keys import CONTENT_FIELDS, content_key, generator_short_name, task_key
from demur.plans.shared import join_way

GROUP = ("generator_model", "content_key", "source_qid", "perturbation_class", "intensity", "lever_selected")

_OUTCOMES = {"PASS": 1, "FAIL": 2, "ERROR": 3, "OTHER": 4}
_LABELS = {label: i for i, label in enumerate((vocab.ANSWER_LABEL, *vocab.REFUSAL_CODES), start=1)}
_OTHER_LABEL = 15
# field -> (lowest bit, number of bits); the line number takes the bits above
_FLAGS = {
    "lever_correctly_implemented": 3,
    "intensity_correctly_achieved": 5,
    "uncertainty_successfully_induced": 7,
    "answer_constraint_satisfied": 9,
}
_GENERATED_BIT, _LABEL_BIT, _LINE_BIT = 11, 12, 16


def _packed(votes: DataFrame) -> Column:
    """line_no, label, flags and outcome of one vote as one long."""
    terms = [
        # without its line a vote could not be found again
        f"coalesce(line_no, raise_error('votes need line_no: read them with numbered=True')) * {1 << _LINE_BIT}",
        f"""CASE WHEN NOT coalesce(verification_successful, false) THEN {_OUTCOMES["ERROR"]}
            WHEN verification_result = 'PASS' THEN {_OUTCOMES["PASS"]}
            WHEN verification_result = 'FAIL' THEN {_OUTCOMES["FAIL"]} ELSE {_OUTCOMES["OTHER"]} END""",
    ]
    for name, bit in _FLAGS.items():
        if name in votes.columns:
            terms.append(f"CASE WHEN {name} THEN {2 << bit} WHEN NOT {name} THEN {1 << bit} ELSE 0 END")
    if "generation_successful" in votes.columns:
        terms.append(f"CASE WHEN generation_successful THEN {1 << _GENERATED_BIT} ELSE 0 END")
    if "final_ground_truth_label" in votes.columns:
        known = " ".join(f"WHEN '{label}' THEN {i}" for label, i in _LABELS.items())
        terms.append(
            f"CASE WHEN final_ground_truth_label IS NULL THEN 0 ELSE "
            f"(CASE final_ground_truth_label {known} ELSE {_OTHER_LABEL} END) * {1 << _LABEL_BIT} END"
        )
    return F.expr(" + ".join(f"CAST({t} AS BIGINT)" for t in terms))


def _unpacked(verifier: str, slot: str) -> str:
    """SQL of the readable vote held in a packed column."""
    results = " ".join(f"WHEN {code} THEN '{name}'" for name, code in _OUTCOMES.items())
    labels = " ".join(f"WHEN {i} THEN '{label}'" for label, i in _LABELS.items())
    flags = ", ".join(
        f"'{name}', CASE shiftright({slot}, {bit}) & 3 WHEN 2 THEN true WHEN 1 THEN false END" for name, bit in _FLAGS.items()
    )
    return f"""named_struct('verifier_model', '{verifier}',
        'result', CASE WHEN {slot} IS NULL THEN 'MISSING' ELSE CASE {slot} & 7 {results} END END, {flags},
        'generation_successful', shiftright({slot}, {_GENERATED_BIT}) & 1 = 1,
        'final_ground_truth_label', CASE shiftright({slot}, {_LABEL_BIT}) & 15 {labels} END,
        'line_no', shiftright({slot}, {_LINE_BIT}))"""


def _slots(verifiers: Sequence[str]) -> list[str]:
    return [f"v{i}" for i in range(len(verifiers))]


def packed_votes(votes: DataFrame, content: Sequence[str | Column] = CONTENT_FIELDS, verifiers: Sequence[str] = vocab.VERIFIERS) -> DataFrame:
    """One row per (generator, content) with the last vote of every verifier as a packed long, null if absent."""
    last = [F.expr(f"max(CASE WHEN verifier_model = '{v}' THEN _packed END) AS {slot}") for v, slot in zip(verifiers, _slots(verifiers))]
    narrow = votes.select(
        "generator_model", content_key(content).alias("content_key"), "source_qid", "perturbation_class", "intensity",
        "lever_selected", "verifier_model", _packed(votes).alias("_packed"),
    ).filter(col("verifier_model").isin(*verifiers))
    return narrow.groupBy(*GROUP).agg(*last)


def merge_packed(packed: DataFrame) -> DataFrame:
    """Packed votes of the same content, put together: the higher line wins."""
    return packed.groupBy(*GROUP).agg(*[F.max(c).alias(c) for c in packed.columns if c not in GROUP])


def unpacked_votes(packed: DataFrame, verifiers: Sequence[str] = vocab.VERIFIERS) -> DataFrame:
    """Packed votes as readable ones, with what follows from them."""
    slots = _slots(verifiers)

    def number(condition: str) -> str:
        return " + ".join(f"CASE WHEN {condition.format(slot)} THEN 1 ELSE 0 END" for slot in slots)

    n = len(verifiers)
    responding, successful = number("{0} IS NOT NULL"), number(f"{{0}} & 7 <> {_OUTCOMES['ERROR']}")
    passed, failed = number(f"{{0}} & 7 = {_OUTCOMES['PASS']}"), number(f"{{0}} & 7 = {_OUTCOMES['FAIL']}")
    return packed.selectExpr(
        *GROUP,
        f"array({', '.join(_unpacked(v, slot) for v, slot in zip(verifiers, slots))}) AS votes",
        f"{responding} AS responding",
        f"{successful} AS successful",
        f"{passed} AS pass_votes",
        f"{failed} AS fail_votes",
        f"{responding} = {n} AS is_complete",
        f"{successful} = {n} AND {passed} = {n} AS has_unanimous_pass",
        f"{passed} > ({successful}) / 2 AS has_majority_pass",
    )


def align(
    votes: DataFrame,
    content: Sequence[str | Column] = CONTENT_FIELDS,
    verifiers: Sequence[str] = vocab.VERIFIERS,
) -> DataFrame:
    """One row per (generator, content) with the last vote of every verifier.

    ``votes`` is an array in the order of ``verifiers``, absent ones marked MISSING.
    """
    return unpacked_votes(packed_votes(votes, content, verifiers), verifiers)


def vote_tally(aligned: DataFrame, verifiers: Sequence[str] = vocab.VERIFIERS) -> DataFrame:
    """Counts and one result column per verifier (ERROR = failed, MISSING = absent)."""
    results = [col("votes")[i]["result"].alias(f"result_{v}") for i, v in enumerate(verifiers)]
    return aligned.select(*GROUP, "responding", "successful", "pass_votes", "fail_votes", *results)


def complete(aligned: DataFrame) -> DataFrame:
    return aligned.filter("is_complete")


def unanimous_filter(aligned: DataFrame) -> DataFrame:
    return aligned.filter("is_complete AND has_unanimous_pass")


def majority_filter(aligned: DataFrame) -> DataFrame:
    """PASS votes are more than half of the successful ones; errors leave the denominator."""
    return aligned.filter("is_complete AND has_majority_pass")


def agreed(aligned: DataFrame, mode: str) -> DataFrame:
    if mode not in ("unanimous", "majority"):
        raise ValueError("mode must be 'unanimous' or 'majority'")
    return unanimous_filter(aligned) if mode == "unanimous" else majority_filter(aligned)


def valid_vote_filter(aligned: DataFrame, mode: str = "all_agree") -> DataFrame:
    """Looser rule on the successful votes only; verifiers may be missing."""
    if mode not in ("all_agree", "majority_agree"):
        raise ValueError("mode must be 'all_agree' or 'majority_agree'")
    rule = col("pass_votes") == col("successful") if mode == "all_agree" else col("has_majority_pass")
    return aligned.filter((col("successful") > 0) & rule)


def vote_statistics(aligned: DataFrame) -> DataFrame:
    """Per content, over the PASS and FAIL votes; null without any."""
    valid = col("pass_votes") + col("fail_votes")

    def known(c: Column) -> Column:
        return F.when(valid > 0, c)

    return aligned.select(
        *GROUP, known(valid).alias("total_valid_verifications"),
        known(col("pass_votes")).alias("valid_pass_votes"), known(col("fail_votes")).alias("valid_fail_votes"),
        known(percent("pass_votes", valid)).alias("pass_percentage"),
        known(col("pass_votes") == valid).alias("unanimous_pass"), known(col("fail_votes") == valid).alias("unanimous_fail"),
        known(col("pass_votes") > valid / 2).alias("majority_pass"), known(col("fail_votes") > valid / 2).alias("majority_fail"),
    )


def agreement_funnel(aligned: DataFrame, mode: str = "unanimous") -> DataFrame:
    kept = col("has_unanimous_pass") if mode == "unanimous" else col("has_majority_pass")
    return (
        aligned.groupBy("generator_model")
        .agg(
            F.count(F.lit(1)).alias("total_groups"), F.count_if("is_complete").alias("complete_groups"),
            F.count_if(col("is_complete") & col("has_unanimous_pass")).alias("unanimous_groups"),
            F.count_if(col("is_complete") & col("has_majority_pass")).alias("majority_groups"),
            F.count_if(col("is_complete") & kept).alias("qualifying_groups"),
        )
        .withColumn("efficiency", percent("qualifying_groups", "complete_groups"))
    )


def generation_success_filter(kept: DataFrame) -> DataFrame:
    """Also require that the rewrite itself was generated, by the first verifier's record."""
    first = F.filter("votes", lambda v: v["result"] != "MISSING")
    return kept.filter(F.try_element_at(first, F.lit(1))["generation_successful"])


def label_distribution(kept: DataFrame) -> DataFrame:
    """Kept rows by class, by intensity and by expected label, long format."""
    label = F.when(col("intensity") == "LOW", F.lit(vocab.ANSWER_LABEL)).otherwise(value_of(vocab.CODE_OF_CLASS, "perturbation_class"))
    base = kept.groupBy("perturbation_class", "intensity").agg(F.count(F.lit(1)).alias("n")).withColumn("label", label)
    t = (
        base.groupingSets([["perturbation_class"], ["intensity"], ["label"]], "perturbation_class", "intensity", "label")
        .agg(F.grouping_id().alias("gid"), F.sum("n").alias("n"))
    )
    return t.select(
        F.when(col("gid") == 0b011, "class").when(col("gid") == 0b101, "intensity").otherwise("label").alias("dimension"),
        F.when(col("gid") == 0b011, col("perturbation_class")).when(col("gid") == 0b101, col("intensity")).otherwise(col("label")).alias("value"),
        "n",
    )


def verifier_pairs(aligned: DataFrame, verifiers: Sequence[str] = vocab.VERIFIERS) -> DataFrame:
    """Every unordered pair of verifiers that both voted, from the aligned row itself.

    The number of pairs is fixed by the verifier list (6 for 4), not by the data.
    """
    v = col("votes")
    pairs = [
        F.struct(
            F.lit(a).alias("verifier_a"), F.lit(b).alias("verifier_b"),
            v[i]["result"].alias("result_a"), v[j]["result"].alias("result_b"),
        )
        for (i, a), (j, b) in combinations(enumerate(verifiers), 2)
    ]
    rows = aligned.select("generator_model", "content_key", F.inline(F.array(*pairs)))
    return rows.filter((col("result_a") != "MISSING") & (col("result_b") != "MISSING"))


# --- fetching the texts --------------------------------------------------------------


def base_verification(votes: DataFrame, aligned: DataFrame, content: Sequence[str | Column] = CONTENT_FIELDS) -> DataFrame:
    """The full record of each content's first responding verifier.

    Joins on (content, verifier, line), which is unique per vote, so a content with very
    many votes does not end up in one task. The contents are sent to the records only where
    they were written and are few; otherwise both sides meet in a shuffle.
    """
    way = join_way(aligned)
    first = F.filter("votes", lambda v: v["result"] != "MISSING")[0]
    wanted = aligned.select(
        "generator_model", "content_key", first["verifier_model"].alias("verifier_model"), first["line_no"].alias("line_no")
    )
    records = votes.withColumn("content_key", content_key(content))
    return records.join(wanted.hint(way), ["generator_model", "content_key", "verifier_model", "line_no"], "left_semi")


def representatives(
    votes: DataFrame, kept: DataFrame, content: Sequence[str | Column] = CONTENT_FIELDS, verifiers: Sequence[str] = vocab.VERIFIERS
) -> DataFrame:
    """``base_verification`` for complete contents: their first verifier is known, so
    only that verifier's records are read and shuffled."""
    return base_verification(votes.filter(col("verifier_model") == verifiers[0]), kept, content)


def common_tasks(votes: DataFrame, kept: DataFrame, prefix: int | None = None) -> DataFrame:
    """Tasks agreed in every generator that has any agreed content, at least two.

    One content per (generator, task), the last line winning. Output has one row per
    generator and task.
    """
    rows = representatives(votes, kept).select("generator_model", "content_key", "line_no", task_key(prefix).alias("task_key"))
    last = Window.partitionBy("generator_model", "task_key").orderBy(F.desc("line_no"), F.desc("content_key"))
    single = rows.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn")
    generators = only_value(kept.agg(F.count_distinct("generator_model")))
    seen = F.count(F.lit(1)).over(Window.partitionBy("task_key"))  # at most one row per generator by now
    return single.withColumn("seen", seen).filter((col("seen") == generators) & (generators >= 2)).drop("seen")


def intersect_tasks(votes: DataFrame, kept: DataFrame) -> DataFrame:
    return common_tasks(votes, kept).select("task_key").distinct()


def annotate(votes: DataFrame, content: Sequence[str | Column] = CONTENT_FIELDS) -> DataFrame:
    """Add short and full names, the source folder and the content id to votes."""
    full = {short: full for full, short in vocab.GENERATOR_SHORT.items()}
    folder = {vocab.GENERATOR_SHORT[full]: folder for folder, full in vocab.GENERATOR_FOLDERS.items()}
    return votes.withColumns({
        "generator_model_full": F.coalesce(value_of(full, "generator_model"), col("generator_model")),
        "verifier_model_full": F.coalesce(value_of(vocab.VERIFIER_IDS, "verifier_model"), col("verifier_model")),
        "source_folder": F.coalesce(value_of(folder, "generator_model"), F.concat(F.lit("dataset_"), generator_short_name("generator_model"))),
        "content_key": content_key(content),
    })


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def voting_generators(matrix: DataFrame) -> DataFrame:
    """Generators with any vote by themselves or by another verifier."""
    own = matrix.filter((col("generator_model") == col("verifier_model")) & (col("total") > 0)).select("generator_model")
    cross = matrix.filter((col("generator_model") != col("verifier_model")) & (col("total") > 0)).select("generator_model")
    return own.union(cross).distinct()
