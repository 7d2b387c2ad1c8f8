"""Single-row transformations: base instances, labels, gates, flattened metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demur import vocab
from demur.functions.columns import col, text_or, value_of


def as_answers(df: DataFrame, column: str = "answer") -> Column:
    """The answers as an array; a bare string becomes an array of one."""
    c = col(column)
    return c if isinstance(df.schema[column].dataType, T.ArrayType) else F.array(c)


def base_instances(df: DataFrame, max_instances: int | None = None) -> DataFrame:
    """Questions with a context, all of them or the first ``max_instances`` in line order.
    """
    first_gold = F.try_element_at("gold_docs", F.lit(1))
    context = F.when(F.size("gold_docs") > 0, first_gold).otherwise(F.try_element_at("retrieved_docs", F.lit(1)))
    out = df.select(
        "line_no", F.coalesce("qid", col("line_no").cast("string")).alias("qid"), "query",
        F.coalesce(context, F.lit("")).alias("context"), as_answers(df).alias("answers"),
    ).filter((F.length("query") > 0) & (F.length("context") > 0))
    return out if max_instances is None else limit_examples(out, max_instances)


def limit_examples(df: DataFrame, n: int) -> DataFrame:
    """The first n rows in file order."""
    return df.orderBy("line_no").limit(n)


def ground_truth(df: DataFrame, family: str = "single") -> DataFrame:
    """Expected label and target of the (class, intensity) cell; unknown classes flagged."""
    targets = vocab.TARGET_SINGLE if family == "single" else vocab.TARGET_MULTI
    code = value_of(vocab.CODE_OF_CLASS, "perturbation_class")
    return df.withColumns({
        "expected_label": F.when(code.isNull(), F.lit(None)).when(col("intensity") == "LOW", F.lit(vocab.ANSWER_LABEL)).otherwise(code),
        "target": value_of(targets, "perturbation_class"),
        "known_class": code.isNotNull(),
    })


def is_answerable(label: str | Column = "ground_truth_label") -> Column:
    return F.coalesce(col(label) == vocab.ANSWER_LABEL, F.lit(False))


def composition(df: DataFrame, label: str = "ground_truth_label") -> DataFrame:
    """How many rows are answerable and how many are not."""
    yes = is_answerable(label)
    return df.agg(F.count_if(yes).alias("answerable"), F.count_if(~yes).alias("unanswerable"))


_TOP = ("question_category", "topic_tag", "question_tag", "question_type", "question_complexity", "question_popularity")
_PERTURBATION = ("perturbation_class", "intensity", "lever_selected", "generation_successful", "source_qid", "expected_rag_behavior")
_STRATIFIED = ("generator_model", "generator_model_full", "source_folder", "unique_id", "stratum_key")
_CURATION = {"source_dataset": "source_dataset", "curation_status": "status", "normalization_strategy": "normalization_strategy"}


def flatten(
    df: DataFrame, perturbation: str = "perturbation_metadata", stratified: str = "stratified_metadata", curation: str = "curation_notes"
) -> DataFrame:
    """Nested multi-document metadata as flat columns.

    Null and empty text both become 'unknown', a missing expected behaviour becomes
    ANSWER_CORRECTLY. Only the named leaves are read from nested Parquet.
    """
    def or_unknown(c: Column) -> Column:
        return text_or(c, "unknown")

    behaviour = text_or(col(perturbation)["expected_rag_behavior"], vocab.ANSWER_LABEL)
    return df.select(
        "sample_id", "question", "answer_generate",
        *[or_unknown(col(c)).alias(c) for c in _TOP],
        *[or_unknown(col(curation)[leaf]).alias(name) for name, leaf in _CURATION.items()],
        *[or_unknown(col(perturbation)[c]).alias(c) for c in ("perturbation_class", "intensity", "lever_selected", "source_qid")],
        col(perturbation)["generation_successful"].alias("generation_successful"),
        *[or_unknown(col(stratified)[c]).alias(c) for c in _STRATIFIED],
        behaviour.alias("expected_behavior"), (behaviour == vocab.ANSWER_LABEL).alias("is_answerable"),
    )


def _absent(c: str) -> Column:
    return F.coalesce(F.length(col(c)), F.lit(0)) == 0


def verification_gate(df: DataFrame, family: str = "single") -> DataFrame:
    """Why a rewrite gets no verification request; null where it gets one.

    single needs original_query, original_context; multi needs a valid record, the
    question, the reference answer and a parsed reply.
    """
    failed = ~F.coalesce(col("generation_successful"), F.lit(False))
    if family == "single":
        incomplete = _absent("original_query") | _absent("original_context") | _absent("perturbation_class") | _absent("intensity")
        error = F.when(failed, "Original generation failed").when(incomplete, "Missing required fields")
    else:
        incomplete = _absent("question") | _absent("answer_generate") | _absent("perturbation_class") | _absent("intensity")
        error = (
            F.when(~col("is_valid"), "Invalid input data format").when(failed, "Original generation failed")
            .when(incomplete, "Missing required fields")
            .when(~F.coalesce(col("parsing_successful"), F.lit(False)), "Generation parsing failed")
        )
    return df.withColumn("verification_error", error)


def evaluation_gate(df: DataFrame, context: str = "context", query: str = "query") -> DataFrame:
    """Only samples that have both a context and a query."""
    return df.filter((F.length(context) > 0) & (F.length(query) > 0))
