"""Multi-document records: passages, curation and reversible patches.

A record carries its passages as ``grounding``, an array of one-key maps
``{cite_<n>: text}``, with the label arrays ``evidence_correct``, ``evidence_cited`` and
``evidence_relevant`` aligned by position. Everything here works inside the arrays of one
row - around ten passages - so nothing is exploded and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demur import vocab
from demur.functions.columns import col, literal_table, strip

LABEL_ARRAYS = ("evidence_correct", "evidence_cited", "evidence_relevant")


def eligible(df: DataFrame, total: int = vocab.TOTAL_PASSAGES) -> DataFrame:
    """Validated, answerable, simple and stable questions with enough passages."""
    return df.filter(
        (col("answer_validate") == "YES")
        & F.array_contains("evidence_correct", vocab.SIGNAL_LABEL)
        & col("question_complexity").isin(*vocab.SIMPLE_COMPLEXITIES)
        & col("question_type").isin(*vocab.STABLE_TYPES)
        & (F.size("grounding") >= total)
        & col("question_category").isNotNull()
    )


def domain_candidates(df: DataFrame, domains: Sequence[str] = vocab.TARGET_DOMAINS) -> DataFrame:
    """Number of candidates per target domain, 0 included."""
    wanted = literal_table(df.sparkSession, ("domain",), [(d,) for d in domains])
    counts = df.filter(col("question_category").isin(*domains)).groupBy(col("question_category").alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("candidates"))


def _cited(passage: Column) -> Column:
    """The first non-null text under a cite_ key, or null."""
    texts = F.map_values(F.map_filter(passage, lambda k, v: F.startswith(k, F.lit("cite_")) & v.isNotNull()))
    return F.try_element_at(texts, F.lit(1))


def passage_text(passage: str | Column) -> Column:
    return strip(_cited(col(passage)))


def split_passages(df: DataFrame) -> DataFrame:
    """Add texts and original indices of signal and noise passages.

    Signal is what is labelled as answering the question; an unlabelled passage is noise;
    a passage without text is neither.
    """
    numbered = F.transform(
        "grounding",
        lambda p, i: F.struct(
            i.alias("idx"), passage_text(p).alias("text"),
            F.coalesce(F.get(col("evidence_correct"), i) == vocab.SIGNAL_LABEL, F.lit(False)).alias("signal"),
        ),
    )
    return df.withColumn("_p", F.filter(numbered, lambda x: F.length(x["text"]) > 0)).withColumns({
        "signal_passages": F.transform(F.filter("_p", lambda x: x["signal"]), lambda x: x["text"]),
        "noise_passages": F.transform(F.filter("_p", lambda x: ~x["signal"]), lambda x: x["text"]),
        "signal_indices": F.transform(F.filter("_p", lambda x: x["signal"]), lambda x: x["idx"]),
        "noise_indices": F.transform(F.filter("_p", lambda x: ~x["signal"]), lambda x: x["idx"]),
    }).drop("_p")


def priority_sort(indices: Column, correct: Column, cited: Column) -> Column:
    """Indices with cited passages first, related ones next, the others last; stable."""
    def entry(i: Column) -> Column:
        rank = F.when(F.get(cited, i) == "YES", 0).when(F.get(correct, i) == vocab.RELATED_LABEL, 1).otherwise(2)
        return F.struct(rank.alias("rank"), i.alias("idx"))

    return F.transform(F.array_sort(F.transform(indices, entry)), lambda x: x["idx"])


def compose(
    df: DataFrame, total: int = vocab.TOTAL_PASSAGES, signal: int = vocab.SIGNAL_PASSAGES, source_dataset: str | None = None
) -> DataFrame:
    """Cut every record to exactly ``total`` passages, at most ``signal`` of them signal.

    The rest is noise; surplus signal never makes up for missing noise, and a record that
    cannot be filled is dropped.
    """
    correct, cited = col("evidence_correct"), col("evidence_cited")
    every = F.transform("grounding", lambda p, i: i)
    is_signal = lambda i: F.coalesce(F.get(correct, i) == vocab.SIGNAL_LABEL, F.lit(False))
    out = df.withColumns({
        "_s": F.slice(priority_sort(F.filter(every, is_signal), correct, cited), 1, signal),
        "_n": priority_sort(F.filter(every, lambda i: ~is_signal(i)), correct, cited),
    })
    out = out.withColumn("_n", F.slice("_n", F.lit(1), F.lit(total) - F.size("_s")))
    out = out.withColumn("_kept", F.array_sort(F.concat("_s", "_n"))).filter(F.size("_kept") == total)

    def at_kept(c: str) -> Column:
        return F.transform("_kept", lambda i: F.get(col(c), i))

    picked = {c: at_kept(c) for c in ("grounding", *LABEL_ARRAYS) if c in df.columns}
    return out.withColumns(picked | {"curation_notes": curation_notes("_s", "_n", total, source_dataset)}).drop("_s", "_n", "_kept")


def curation_notes(signal: str, noise: str, total: int, source_dataset: str | None) -> Column:
    return F.struct(
        F.lit(source_dataset).cast("string").alias("source_dataset"), F.lit("Pristine").alias("status"),
        F.lit(total).alias("passages_normalized_to"),
        F.format_string("%d_signal_%d_noise", F.size(signal), F.size(noise)).alias("normalization_strategy"),
    )


def format_passages(passages: str | Column = "grounding") -> Column:
    """'[1] text' blocks separated by blank lines, as shown to the models."""
    def block(p: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        return F.concat(F.lit("["), number, F.lit("] "), F.coalesce(passage_text(p), F.concat(F.lit("No cite field found in passage "), number)))

    c = col(passages)
    return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit("No search results provided.")).otherwise(F.array_join(F.transform(c, block), "\n\n"))


def list_passages(texts: str | Column, prefix: str) -> Column:
    """'Passage S1: text' lines for the generator and verifier prompts."""
    c = col(texts)
    lines = F.transform(c, lambda t, i: F.concat(F.lit(f"  Passage {prefix}"), (i + 1).cast("string"), F.lit(": "), t))
    return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit("  [None provided]")).otherwise(F.array_join(lines, "\n"))


def relevant(grounding: str | Column = "grounding", correct: str | Column = "evidence_correct") -> Column:
    """Passages labelled as answering the question, in order."""
    g, labels = col(grounding), col(correct)
    return F.filter(g, lambda p, i: F.get(labels, i) == vocab.SIGNAL_LABEL)


# --- reversible records -----------------------------------------------------------------

def validate(df: DataFrame, original: str = "original_data") -> DataFrame:
    """Add ``is_valid`` and the list of ``missing`` parts of a reversible record."""
    fields = [original, "passage_mapping", "perturbation_metadata", "perturbation_results"]
    nested = [
        ("passage_mapping", "signal_indices"), ("passage_mapping", "noise_indices"), ("perturbation_metadata", "perturbation_class"),
        ("perturbation_metadata", "intensity"), ("perturbation_metadata", "generation_successful"),
    ]
    names = [F.when(col(f).isNull(), F.lit(f)) for f in fields]
    names += [F.when(col(parent)[leaf].isNull(), F.lit(f"{parent}.{leaf}")) for parent, leaf in nested]
    return df.withColumn("missing", F.array_compact(F.array(*names))).withColumn("is_valid", F.size("missing") == 0)


def _patched(grounding: Column, patches: Column, indices: Column) -> Column:
    """Fold patches over the passages in order, so the last patch of an index wins.

    A patch counts positions within the signal (noise) list; positions past its end are
    ignored. The text goes under the passage's first cite_ key.
    """
    def replaced(passage: Column, text: Column) -> Column:
        key = F.try_element_at(F.map_keys(F.map_filter(passage, lambda k, v: F.startswith(k, F.lit("cite_")))), F.lit(1))
        return F.transform_values(passage, lambda k, v: F.when(k == key, text).otherwise(v))

    def apply(acc: Column, patch: Column) -> Column:
        at = F.coalesce(patch["original_index"], F.lit(0))
        # a negative position counts from the end of the list
        target = F.when(at < F.size(indices), F.try_element_at(indices, F.when(at >= 0, at + 1).otherwise(at)))
        return F.transform(acc, lambda p, i: F.when(i == target, replaced(p, patch["perturbed_text"])).otherwise(p))

    empty = F.array().cast("array<struct<original_index:int,perturbed_text:string>>")
    return F.aggregate(F.coalesce(patches, empty), grounding, apply)


def apply_patches(df: DataFrame) -> DataFrame:
    """Apply ``signal_patches`` and ``noise_patches`` where the reply parsed.

    Input: question, grounding, signal_indices, noise_indices, perturbed_query,
    signal_patches, noise_patches, parsing_successful. The originals stay available
    as ``original_question`` and ``original_grounding``.
    """
    ok = F.coalesce(col("parsing_successful"), F.lit(False))
    signal = _patched(col("grounding"), col("signal_patches"), col("signal_indices"))
    both = _patched(col("_g"), col("noise_patches"), col("noise_indices"))
    return (
        df.withColumns({"original_question": col("question"), "original_grounding": col("grounding"), "_g": signal})
        .withColumns({
            "question": F.when(ok & col("perturbed_query").isNotNull(), col("perturbed_query")).otherwise(col("question")),
            "grounding": F.when(ok, both).otherwise(col("grounding")),
        })
        .drop("_g")
    )


def restore(df: DataFrame) -> DataFrame:
    """Undo ``apply_patches``."""
    return df.withColumns({"question": col("original_question"), "grounding": col("original_grounding")}).drop(
        "original_question", "original_grounding"
    )
