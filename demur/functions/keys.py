"""Identity keys of rewrites, tasks and samples.

Keys are joined from the fields themselves; ``*_key`` is the md5 of the joined text, so
that joins and groupings move 32 characters instead of whole passages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demur import vocab
from demur.functions.columns import col, joined, unambiguous, value_of
from demur.plans.shared import discard, materialise

CONTENT_FIELDS = ("source_qid", "perturbed_query", "perturbed_context", "perturbation_class", "intensity", "lever_selected")
BARS = "|||"


def patches_text(c: str | Column) -> Column:
    """Patch list as canonical JSON, '[]' when absent."""
    return F.coalesce(F.to_json(col(c)), F.lit("[]"))


def multi_content_fields() -> list[Column]:
    return [
        col("source_qid"), col("perturbed_query"), patches_text("perturbed_signal_passages"),
        patches_text("perturbed_noise_passages"), col("perturbation_class"), col("intensity"), col("lever_selected"),
    ]


def stratum_key(perturbation_class: str | Column = "perturbation_class", intensity: str | Column = "intensity") -> Column:
    unknown = F.lit("unknown")
    return F.concat_ws("_", F.coalesce(col(perturbation_class), unknown), F.upper(F.coalesce(col(intensity), unknown)))


def content_id(fields: Sequence[str | Column] = CONTENT_FIELDS) -> Column:
    """Exactly the same rewritten content, readable."""
    return joined(fields)


def content_key(fields: Sequence[str | Column] = CONTENT_FIELDS) -> Column:
    return F.md5(unambiguous(fields))


def _digest(c: str | Column) -> Column:
    return F.md5(F.coalesce(col(c), F.lit("")))


def task_id(prefix: int | None = None) -> Column:
    """The same task whichever generator worked on it: no lever, the context by its digest.

    ``prefix`` gives the older form with the first characters of the context instead, which
    takes different tasks for one where contexts start alike.
    """
    context = _digest("original_context") if prefix is None else F.substring("original_context", 1, prefix)
    return joined(["source_qid", "original_query", "perturbation_class", "intensity", context])


def task_key(prefix: int | None = None) -> Column:
    if prefix is not None:
        return F.md5(task_id(prefix))
    return F.md5(unambiguous(["source_qid", "original_query", "perturbation_class", "intensity", "original_context"]))


RESUME_FIELDS = (
    "generator_model", "source_qid", "original_query", "original_context", "perturbation_class", "intensity", "lever_selected",
    "perturbed_query", "perturbed_context",
)


def resume_fields(kind: str = "single") -> list[str | Column]:
    if kind == "single":
        return list(RESUME_FIELDS)
    return ["generator_model", "original_query", *multi_content_fields()]


def perturbation_id(kind: str = "single", prefix: int | None = None) -> Column:
    """Resume key of the verification stage: the whole rewrite, its question and its generator.

    ``prefix`` gives the older readable form that cuts the context (or question) and leaves
    out generator, lever and rewritten text.
    """
    if prefix is None:
        return F.md5(unambiguous(resume_fields(kind)))
    if kind == "single":
        return joined(["original_query", "perturbation_class", "intensity", F.substring("original_context", 1, prefix)])
    return joined(["source_qid", "perturbation_class", "intensity", F.substring("original_query", 1, prefix)])


def verifier_short_name(c: str | Column) -> Column:
    """claude, nova, gpt or deepseek if contained, else the last path part up to ':'."""
    last = F.substring_index(col(c), "/", -1)
    name = F.replace(F.substring_index(last, ":", 1), F.lit("."), F.lit("_"))
    for short in reversed(vocab.VERIFIERS):
        name = F.when(F.contains(col(c), F.lit(short)), F.lit(short)).otherwise(name)
    return name


def generator_short_name(c: str | Column) -> Column:
    """Alias if there is one, else the text before the first '-'."""
    return F.coalesce(value_of(vocab.GENERATOR_SHORT, c), F.substring_index(col(c), "-", 1))


def sample_uid(ident: str | Column = "sample_id", entry_idx: str | Column = "entry_idx") -> Column:
    return F.concat_ws("_", F.coalesce(col(ident), F.lit("unknown")), col(entry_idx).cast("string"))


_HASHED = {
    "stratified": ["perturbed_query", "perturbed_context", "generator_model"],
    "task": ["perturbed_query", "perturbed_context", "generator_model", "task_id"],
    "reference": ["perturbed_query", "perturbed_context", "implementation_reasoning", "lever_selected"],
    "multi": ["perturbed_query", "signal_text", "noise_text", "generator_model"],
}


#: rows of about 60 bytes
LATER_BROADCAST = 500_000


def unique_key(df: DataFrame, variant: str = "stratified", ident: str | Column = "content_key", name: str = "unique_id") -> DataFrame:
    """Add a printable primary key ending in an ordinal.

    The ordinal tells apart rows that agree in everything before it, among them a digest of
    the content, so nearly all rows have the first. It is counted on (prefix, ident) alone;
    the ordinals from the second on are written first, so their number is known: none need no
    join, up to ``LATER_BROADCAST`` are broadcast. No text passes a window, and none is
    shuffled unless there are more. The rows are computed once for the count and once for
    the result; write them before where that is more than a scan.
    """
    if variant == "multi":
        df = df.withColumns({
            "signal_text": patches_text("perturbed_signal_passages"), "noise_text": patches_text("perturbed_noise_passages")
        })
    unknown = F.lit("unknown")
    parts = [F.coalesce(col(c), unknown) for c in ("source_qid", "perturbation_class", "intensity")]
    if variant != "reference":
        parts.insert(0, generator_short_name("generator_model"))
    digest = F.substring(F.md5(joined(_HASHED[variant], BARS)), 1, 8)
    prefix = F.concat_ws("_", F.lit("RB"), *parts, digest)
    out = df.withColumns({"_prefix": prefix, "_ident": col(ident).cast("string")})
    place = F.row_number().over(Window.partitionBy("_prefix").orderBy("_ident"))
    later = materialise(out.select("_prefix", "_ident").distinct().withColumn("_n", place).filter("_n > 1"), "ordinals")
    n_later = later.limit(LATER_BROADCAST + 1).count()
    if n_later:
        later = F.broadcast(later) if n_later <= LATER_BROADCAST else later.hint("merge")
        out = out.join(later, ["_prefix", "_ident"], "left")
    else:
        discard(later)
        out = out.withColumn("_n", F.lit(None).cast("int"))
    out = out.withColumn(name, F.concat_ws("_", "_prefix", F.format_string("%04d", F.coalesce("_n", F.lit(1)))))
    return out.drop("_prefix", "_ident", "_n", "signal_text", "noise_text")
