"""Reading model replies: JSON in code fences and line-format judgements.

All of it is column expressions on the reply text; every reply is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demur import vocab
from demur.functions.columns import col, strip, strip_start

_FENCE = "```"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_INTEGER = r"^[+-]?\d+$"


def fenced_body(reply: str | Column) -> Column:
    """Text inside the json fence, else inside the first bare fence, else everything.

    A fence that is never closed counts as no fence.
    """
    r = col(reply)

    def inside(opening: str) -> Column:
        rest = F.substr(r, F.locate(opening, r) + len(opening))
        return F.when(F.contains(rest, F.lit(_FENCE)), strip(F.substring_index(rest, _FENCE, 1))).otherwise(r)

    return (
        F.when(F.contains(r, F.lit(_FENCE + "json")), inside(_FENCE + "json"))
        .when(F.contains(r, F.lit(_FENCE)), inside(_FENCE))
        .otherwise(r)
    )


def is_json_object(text: str | Column) -> Column:
    """Strictly one JSON object: no trailing text, no single quotes.

    Spark's parsers stop after the first value, so the text is wrapped in brackets and has
    to give an array of exactly one element.
    """
    t = col(text)
    wrapped = F.concat(F.lit("["), t, F.lit("]"))
    shape = F.rlike(t, F.lit(r"(?s)^\s*\{.*\}\s*$"))
    return F.coalesce(
        shape & F.try_parse_json(t).isNotNull() & F.try_parse_json(wrapped).isNotNull() & (F.json_array_length(wrapped) == 1),
        F.lit(False),
    )


def parse_fenced_json(df: DataFrame, schema: str, reply: str = "response", name: str = "parsed") -> DataFrame:
    """Add the parsed struct, ``parsing_successful``, and error and raw text on failure."""
    ok = is_json_object("_body")
    return (
        df.withColumn("_body", fenced_body(reply)).withColumn("parsing_successful", ok)
        .withColumns({
            name: F.when(col("parsing_successful"), F.from_json("_body", schema, {"allowSingleQuotes": "false"})),
            "parsing_error": F.when(~col("parsing_successful"), F.lit("reply is not a JSON object")),
            "raw_response": F.when(~col("parsing_successful"), col("_body")),
        })
        .drop("_body")
    )


def _with_lines(df: DataFrame, reply: str, **labels: str) -> DataFrame:
    """The stripped value of the first line starting with each 'LABEL:' as a column, null
    without one.

    White space before the very first line does not count, lines end at line feeds only, a
    label repeated on its line ends the value. With a line feed put in front, a line is found
    by plain search for line feed and label; no pattern is matched.
    """
    text = df.withColumn("_text", F.concat(F.lit("\n"), strip_start(reply)))
    starts = text.withColumns({name: F.instr("_text", F.lit(f"\n{label}:")) for name, label in labels.items()})

    def value(start: str, label: str) -> Column:
        line = F.substring_index(F.substr(col("_text"), col(start) + len(label) + 2), "\n", 1)
        return F.when(col(start) > 0, strip(F.substring_index(line, f"{label}:", 1)))

    return starts.withColumns({name: value(name, label) for name, label in labels.items()}).drop("_text")


def parse_judgement(df: DataFrame, reply: str = "response") -> DataFrame:
    """Single-document judgement: class, quality score (1-5 or null), explanation.

    Without a class line or a readable score line, the first refusal code found anywhere
    in the reply decides, else it is an answer attempt.
    """
    lines = _with_lines(df, reply, _kind="CLASSIFICATION", _score="QUALITY_SCORE", _why="EXPLANATION")
    # a failed cast costs an exception per row, so only what looks like a number is cast
    score = F.when((col("_score") != "N/A") & F.rlike("_score", F.lit(_NUMBER)), col("_score").try_cast("double"))
    readable = col("_kind").isNotNull() & F.coalesce((col("_score") == "N/A") | col("_number").isNotNull(), F.lit(False))
    upper = F.upper(col(reply))
    found = F.lit(vocab.ATTEMPT)
    for code in reversed(vocab.REFUSAL_CODES):
        found = F.when(F.contains(upper, F.lit(code)), F.lit(code)).otherwise(found)
    staged = lines.withColumn("_number", score).withColumn("_ok", readable).withColumn("_type", F.when(col("_ok"), col("_kind")).otherwise(found))
    return staged.withColumns({
        "model_predicted_type": col("_type"),
        "judge_quality_score": F.when(col("_ok"), col("_number")),
        "llm_evaluation_explanation": F.when(col("_ok"), F.coalesce("_why", F.lit("")))
        .when(col("_type") == vocab.ATTEMPT, F.lit("unreadable judgement, taken as an answer attempt"))
        .otherwise(F.lit("refusal code found in an unreadable judgement")),
    }).drop("_kind", "_score", "_number", "_why", "_ok", "_type")


def parse_comprehensive(df: DataFrame, reply: str = "response", expected: str = "expected_behavior") -> DataFrame:
    """Multi-document judgement: class, explanation, scores of an answerable sample,
    appropriateness of the refusal of an unanswerable one."""
    lines = _with_lines(
        df, reply, _kind="CLASSIFICATION", _why="EXPLANATION", _elig="ELIGIBILITY", _all="FACTUALITY_ALL", _rel="FACTUALITY_RELEVANT"
    ).withColumn("_kind", F.coalesce("_kind", F.lit(vocab.ATTEMPT)))
    ans, kind = F.coalesce(col("is_answerable"), F.lit(False)), col("_kind")

    def score(c: str) -> Column:
        value = col(c)
        read = (
            F.when(F.upper(value) == "N/A", F.lit(None).cast("int"))
            .when(F.rlike(value, F.lit(_INTEGER)), F.coalesce(value.try_cast("int"), F.lit(0))).otherwise(0)
        )
        return F.when(ans, F.when(kind != vocab.ATTEMPT, 0).otherwise(read))

    right = (kind != vocab.ATTEMPT) & (kind == col(expected))
    return lines.withColumns({
        "refusal_classification": kind,
        "judge_explanation": F.coalesce("_why", F.lit("No explanation provided")),
        "eligibility": score("_elig"),
        "factuality_all": score("_all"),
        "factuality_relevant": score("_rel"),
        "refusal_appropriateness": F.when(~ans, F.coalesce(right, F.lit(False)).cast("int")),
    }).drop("_kind", "_why", "_elig", "_all", "_rel")


def dual_outcome(df: DataFrame, kind: str = "single") -> DataFrame:
    """Compare what the model did with what it should have done.

    A row whose ``error`` is set failed on the way; it becomes type ERROR.
    """
    failed = col("error").isNotNull() if "error" in df.columns else F.lit(False)
    if kind == "single":
        label, got = col("ground_truth_label"), col("model_predicted_type")
        ans, att = label.eqNullSafe(F.lit(vocab.ANSWER_LABEL)), got == vocab.ATTEMPT
        text = (
            F.when(failed, "evaluation failed")
            .when(ans & att, col("llm_evaluation_explanation") if "llm_evaluation_explanation" in df.columns else F.lit(None).cast("string"))
            .when(ans, F.concat(F.lit("false refusal: "), got))
            .when(att, F.concat(F.lit("missed refusal: expected "), label))
            .when(got == label, F.concat(F.lit("exact match: "), got))
            .otherwise(F.concat(F.lit("mismatch: predicted "), got, F.lit(", expected "), label))
        )
        return df.withColumns({
            "answer_quality_score": F.when(~failed & ans & att, col("judge_quality_score")),
            "refusal_match_correct": F.when(failed | (ans & att), F.lit(None).cast("boolean")).when(ans | att, F.lit(False)).otherwise(got == label),
            "llm_evaluation_explanation": text,
            "model_predicted_type": F.when(failed, F.lit(vocab.ERROR)).otherwise(got),
        })
    ans = F.coalesce(col("is_answerable"), F.lit(False))
    got = col("refusal_classification")
    att = got == vocab.ATTEMPT

    def score(c: str) -> Column:
        return F.when(ans, F.when(failed | ~att, 0).otherwise(col(c)))

    return df.withColumns({
        "eligibility_score": score("eligibility"),
        "unadjusted_factuality_score": score("factuality_all"),
        "raf_score": score("factuality_relevant"),
        "refusal_match_correct": F.when(~ans, F.when(failed | att, F.lit(False)).otherwise(F.coalesce(col("refusal_appropriateness") == 1, F.lit(False)))),
        "false_refusal": F.when(ans & ~failed, ~att),
        "missed_refusal": F.when(~ans & ~failed, att),
        "refusal_classification": F.when(failed, F.lit(vocab.ERROR)).otherwise(got),
    })


# --- joining replies to what was asked ---------------------------------------------------


def _overridden(df: DataFrame, parsed: str, names: tuple[str, ...]) -> dict[str, Column]:
    """A field present in the reply replaces ours."""
    inside = df.schema[parsed].dataType.fieldNames()
    return {n: F.coalesce(col(parsed)[n], col(n)) for n in names if n in inside and n in df.columns}


def generation_result(answered: DataFrame, schema: str) -> DataFrame:
    """Rewrite records from requests joined to replies (``attach``); pending ones left out.

    Failed calls and unreadable replies stay as rows with generation_successful = false.
    """
    done = answered.filter(~col("pending"))
    parsed = parse_fenced_json(done, schema).withColumn(
        "parsing_successful", F.when(col("error").isNull(), col("parsing_successful")).otherwise(F.lit(False))
    )
    fields = [f for f in parsed.schema["parsed"].dataType.fieldNames() if f not in answered.columns]
    return parsed.withColumns(
        _overridden(parsed, "parsed", ("perturbation_class", "intensity", "original_query", "original_context"))
        | {f: col("parsed")[f] for f in fields}
        | {"generation_successful": col("parsing_successful"), "error": F.coalesce("error", "parsing_error")}
    ).drop("parsed", "parsing_error", "pending", "response")


def verification_result(answered: DataFrame, schema: str) -> DataFrame:
    """Vote records from rewrites joined to verifier replies; pending ones left out."""
    done = answered.filter(~col("pending"))
    parsed = parse_fenced_json(done, schema, name="verification_response")
    ok = col("error").isNull() & col("parsing_successful")
    return parsed.withColumns({
        "verification_successful": ok,
        "verification_response": F.when(ok, col("verification_response")),
        "verification_error": F.when(~ok, F.coalesce("error", "parsing_error")),
    }).drop("parsing_successful", "parsing_error", "raw_response", "pending", "response", "error")
