"""Request tables: one row per model call still to be made, with its prompt.

The per-cell parts of a prompt (criteria, target, menu of levers) are a table of 18 rows
that is joined map-side; building requests shuffles nothing. The wording is ours; the
fields a prompt contains and the cases it distinguishes follow the benchmark's design.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demur import vocab
from demur.functions.columns import col, joined, literal_array, literal_table
from demur.operators.matching import evaluation_grid, perturbation_grid
from demur.operators.passages import format_passages, list_passages, relevant
from demur.operators.records import verification_gate
from demur.sources.catalogue import all_cells, catalogue, lever_menu
from demur.sources.wording import VERSION

CRITERIA = {
    ("P-Ambiguity", "LOW"): "Other readings are possible, but the passage makes one of them the natural choice.",
    ("P-Ambiguity", "MEDIUM"): "Two or more readings are equally well supported.",
    ("P-Ambiguity", "HIGH"): "Several readings exist and nothing available could decide between them.",
    ("P-Contradiction", "LOW"): "Only side details disagree; the fact asked for is not affected.",
    ("P-Contradiction", "MEDIUM"): "Sources of equal weight disagree on the very fact asked for.",
    ("P-Contradiction", "HIGH"): "The statements exclude each other logically, so no consistent answer exists.",
    ("P-MissingInfo", "LOW"): "Something inessential is gone; everything the answer needs is still there.",
    ("P-MissingInfo", "MEDIUM"): "An important piece is gone and the answer can hardly be inferred.",
    ("P-MissingInfo", "HIGH"): "What any answer would need is entirely absent.",
    ("P-FalsePremise", "LOW"): "The question takes something harmless for granted that the text does not say.",
    ("P-FalsePremise", "MEDIUM"): "The question takes for granted what the text denies.",
    ("P-FalsePremise", "HIGH"): "The question rests on a category mistake or an impossibility and has no meaning.",
    ("P-GranularityMismatch", "LOW"): "Question and text differ by one level of detail that is easily bridged.",
    ("P-GranularityMismatch", "MEDIUM"): "Several levels of detail lie between them and much would have to be combined.",
    ("P-GranularityMismatch", "HIGH"): "The scales have nothing to do with each other and cannot be bridged.",
    ("P-EpistemicMismatch", "LOW"): "A mild judgement is asked for that follows from the stated facts.",
    ("P-EpistemicMismatch", "MEDIUM"): "A standard, a model or a forecast is needed that the text does not offer.",
    ("P-EpistemicMismatch", "HIGH"): "A matter of taste, ethics or pure speculation is asked for.",
}
STRATEGIES = {
    "P-Ambiguity": "Work on the question or on a single signal passage.",
    "P-Contradiction": "Rewrite a single noise passage so that it disagrees with the signal passages.",
    "P-MissingInfo": "Erase the information from every signal passage.",
    "P-FalsePremise": "Change the question only; the passages stay as evidence.",
    "P-GranularityMismatch": "Change the level of detail in every signal passage.",
    "P-EpistemicMismatch": "Remove the factual grounding from every signal passage.",
}
AMBIGUITY_NOTE = (
    "For ambiguity: make it impossible to overlook. Put it into the question, or into every signal passage, so that no "
    "clearer passage can be used instead."
)
REFUSALS = {
    "REFUSE_AMBIGUOUS_QUERY": "the question or a needed passage can be read in ways that lead to different answers",
    "REFUSE_CONTRADICTORY_CONTEXT": "the text contradicts itself on what the answer depends on",
    "REFUSE_INFO_MISSING_IN_CONTEXT": "the text does not contain what is asked for",
    "REFUSE_FALSE_PREMISE_IN_QUERY": "the question assumes something the text denies or does not support",
    "REFUSE_GRANULARITY_MISMATCH": "the text is on the subject but at the wrong level of detail or scale",
    "REFUSE_NONFACTUAL_QUERY": "an opinion, a forecast, a hypothesis or a moral judgement is asked for",
    "REFUSE_OTHER": "something else makes a faithful answer impossible",
}
_FENCE = "```"


#: versions of the wording that are broadcast, at about 40 KB each
MAX_VERSIONS = 500


def default_wording(spark: SparkSession) -> DataFrame:
    """The wording written out in the code, as a table for ``sources.wording``: a row per lever with its cell's criteria and strategy."""
    texts = literal_table(
        spark, ("perturbation_class", "intensity", "criteria", "strategy"), [(c, i, CRITERIA[c, i], STRATEGIES[c]) for c, i in vocab.CELLS]
    )
    return catalogue(spark).join(texts, ["perturbation_class", "intensity"])


def cell_briefs(spark: SparkSession, family: str = "single", wording: DataFrame | None = None) -> DataFrame:
    """Label, target, criteria, strategy and menu of each cell: 18 rows, per version where the wording has versions."""
    words = default_wording(spark) if wording is None else wording
    key = ["perturbation_class", "intensity"]
    by = [*key, VERSION] if VERSION in words.columns else key
    target = "target_single" if family == "single" else "target_multi"
    cells = all_cells(spark).select(*key, "expected_label", F.col(target).alias("target"))
    texts = words.groupBy(*by).agg(F.max("criteria").alias("criteria"), F.max("strategy").alias("strategy"))  # all the same in a cell
    return cells.join(texts, key).join(lever_menu(words, by), by)


def _with_briefs(rows: DataFrame, family: str, wording: DataFrame | None, texts: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows with the texts of their cell, in the version they name; a row that names none is an error.
    ``texts`` are further texts made of a cell's own, put together once per cell and not once per row."""
    briefs = cell_briefs(rows.sparkSession, family, wording).withColumns(dict(texts or {}))
    if VERSION not in briefs.columns:
        return rows.join(F.broadcast(briefs), ["perturbation_class", "intensity"])
    known = rows.withColumn(VERSION, F.coalesce(col(VERSION), F.raise_error(F.lit("no wording is valid at the time of a row")).cast("string")))
    few = wording.select(VERSION).distinct().count() <= MAX_VERSIONS
    # very many versions meet the rows in a join that adaptive execution may split
    return known.join(F.broadcast(briefs) if few else briefs, ["perturbation_class", "intensity", VERSION])


def _kept(keep: Sequence[str], wording: DataFrame | None) -> tuple[str, ...]:
    versioned = wording is not None and VERSION in wording.columns and VERSION not in keep
    return (*keep, VERSION) if versioned else tuple(keep)


def request_id(stage: str, *parts: str | Column) -> Column:
    return F.md5(joined([F.lit(stage), *parts]))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def answer_display(answers: str | Column, maximum: int | None = None) -> Column:
    """Quoted answers joined by OR; beyond a maximum, how many more there are."""
    a = col(answers)
    shown = a if maximum is None else F.slice(a, 1, maximum)
    text = F.array_join(F.transform(shown, _quoted), " OR ")
    if maximum is None:
        return text
    return F.when(F.size(a) > maximum, F.concat(text, F.lit(" (and "), (F.size(a) - maximum).cast("string"), F.lit(" other valid answers)"))).otherwise(text)


def _block(*parts: str | Column) -> Column:
    """Lines of text and columns; a null column leaves its line out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _labelled(label: str, value: str | Column) -> Column:
    return F.concat(F.lit(f"{label}: "), F.coalesce(col(value).cast("string"), F.lit("")))


def _keys(names: Sequence[str]) -> str:
    return f"{_FENCE}json\n{{" + ", ".join(f'"{n}": ...' for n in names) + f"}}\n{_FENCE}"


def constraint_branch(answers: str | Column | None = "answers") -> Column:
    """Which wording of the answer constraint applies: kept or prevented, one or several."""
    kept = F.when(col("intensity") == "LOW", "kept").otherwise("prevented")
    if answers is None:
        return kept
    return F.concat_ws("_", kept, F.when(F.size(col(answers)) == 1, "one").otherwise("several"))


def _constraint(branch: Column, shown: Column) -> Column:
    text = {
        "kept_one": "A careful reader must still be able to reach this answer: ",
        "kept_several": "A careful reader must still be able to reach at least one of these answers: ",
        "prevented_one": "It must no longer be safe to give this answer: ",
        "prevented_several": "It must no longer be safe to give any of these answers: ",
        "kept": "A careful reader must still be able to reach the reference answer: ",
        "prevented": "It must no longer be safe to give the reference answer: ",
    }
    lead = F.lit(None).cast("string")
    for name, words in text.items():
        lead = F.when(branch == name, words).otherwise(lead)
    return F.concat(lead, shown)


def generator_requests(
    instances: DataFrame, family: str = "single", cells: DataFrame | None = None, keep: Sequence[str] = (),
    generator: str | None = None, wording: DataFrame | None = None,
) -> DataFrame:
    """Prompt per (instance, cell). ``generator`` names the model to be asked and becomes part of
    the request_id, so that several generators' requests stay apart. ``cells`` is a work list that already has
    perturbation_class and intensity (``missing_cells``); without it the whole grid.
    ``keep`` names further input columns for the request table. ``wording`` replaces the texts written
    out in the code; if it has versions, every row is worded in its ``wording_version`` (``wording.as_of``), which
    is kept."""
    keep = _kept(keep, wording)
    single = family == "single"
    branch = constraint_branch("answers" if single else None)
    shown = answer_display("answers") if single else col("answer_generate")
    if single:
        own = [_labelled("QUESTION", "query"), _labelled("CONTEXT", "context"), F.concat(F.lit("ANSWERS: "), shown)]
        task, names = [], vocab.GENERATOR_KEYS
    else:
        own = [
            _labelled("QUESTION", "question"), F.concat(F.lit("REFERENCE ANSWER: "), shown), F.lit("SIGNAL PASSAGES:"), list_passages("signal_passages", "S"),
            F.lit("NOISE PASSAGES:"), list_passages("noise_passages", "N"),
        ]
        task = [F.concat(F.lit("STRATEGY: "), col("strategy")), F.when(col("perturbation_class") == "P-Ambiguity", AMBIGUITY_NOTE)]
        names = vocab.GENERATOR_KEYS_MULTI
    # what an instance or a cell brings itself is put together once and not once per pair of them
    of_cell = {
        "_head": _block(
            "Rewrite the material below with exactly one of the listed levers.",
            _labelled("PERTURBATION", "perturbation_class"), _labelled("INTENSITY", "intensity"), _labelled("CHANGE ONLY", "target"),
            _labelled("CRITERIA", "criteria"),
        ),
        "_task": F.nullif(_block(*task), F.lit("")) if task else F.lit(None).cast("string"),  # no line where a cell has none
        "_tail": _block(
            _labelled("EXPECTED BEHAVIOUR", "expected_label"), F.lit("LEVERS:"), col("menu"),
            F.lit("Reply with one JSON object in a json fence:\n" + _keys(names)),
        ),
    }
    worded = (instances if cells is None else cells).withColumns({"_own": _block(*own), "_shown": shown})
    rows = _with_briefs(perturbation_grid(worded) if cells is None else worded, family, wording, of_cell)
    prompt = _block(col("_head"), col("_own"), col("_task"), F.concat(F.lit("CONSTRAINT: "), _constraint(branch, col("_shown"))), col("_tail"))
    return rows.select(
        request_id("generate", *([F.lit(generator)] if generator else []), "qid", "perturbation_class", "intensity").alias("request_id"), col("qid").alias("source_qid"),
        col("line_no").alias("source_line"), "perturbation_class", "intensity", branch.alias("branch"), prompt.alias("prompt"), *keep,
    )


CHECKLIST = (
    "Was the named lever applied as described?", "Is the intended intensity reached?", "Was only the target changed?",
    "Does it create the intended kind of uncertainty?", "Is it sound language?", "Does it meet the answer constraint?",
    "Would a good system behave as expected?", "Would a refusal be for the intended reason?",
)
STRATEGY_CHECK = "Was the strategy followed?"
_REWRITE = ("perturbed_query", "perturbed_context", "lever_selected", "implementation_reasoning", "intensity_achieved")


def verifier_requests(
    rewrites: DataFrame, verifiers: Sequence[str] = vocab.VERIFIERS, family: str = "single", keep: Sequence[str] = (), pending: str | None = None,
    wording: DataFrame | None = None,
) -> DataFrame:
    """Prompt per rewrite and verifier, for the rewrites that pass the gate.

    ``pending`` names an array column with the verifiers to ask about each rewrite; without it
    all of ``verifiers`` are. ``wording`` as for ``generator_requests``.
    """
    keep = _kept(keep, wording)
    single = family == "single"
    rows = verification_gate(rewrites, family).filter(col("verification_error").isNull())
    rows = _with_briefs(rows, family, wording)
    branch = constraint_branch("original_answers" if single and "original_answers" in rewrites.columns else None)
    if single:
        fields = [c for c in _REWRITE if c in rewrites.columns]
        output = F.to_json(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in fields]))
        shown = answer_display("original_answers") if "original_answers" in rewrites.columns else F.lit("")
        material = [_labelled("QUESTION", "original_query"), _labelled("CONTEXT", "original_context"), F.concat(F.lit("ANSWERS: "), shown)]
        names, checks = vocab.VERIFIER_KEYS, CHECKLIST
    else:
        output = F.to_json("perturbation_results", {"ignoreNullFields": "false"})
        shown = col("answer_generate")
        material = [
            _labelled("QUESTION", "question"), F.concat(F.lit("REFERENCE ANSWER: "), shown), F.lit("SIGNAL PASSAGES:"), list_passages("signal_passages", "S"),
            F.lit("NOISE PASSAGES:"), list_passages("noise_passages", "N"), F.concat(F.lit("STRATEGY: "), col("strategy")),
            F.when(col("perturbation_class") == "P-Ambiguity", F.concat(F.lit(AMBIGUITY_NOTE), F.lit(" Check that this was done."))),
        ]
        names, checks = vocab.VERIFIER_KEYS_MULTI, (*CHECKLIST, STRATEGY_CHECK)
    prompt = _block(
        "Check the rewrite below against its task and say PASS or FAIL.",
        _labelled("PERTURBATION", "perturbation_class"), _labelled("INTENSITY", "intensity"), _labelled("CHANGE ONLY", "target"),
        _labelled("CRITERIA", "criteria"), *material, F.concat(F.lit("REWRITE: "), output),
        F.concat(F.lit("CONSTRAINT: "), _constraint(branch, shown)), _labelled("EXPECTED BEHAVIOUR", "expected_label"),
        F.lit("LEVERS:"), col("menu"), F.lit("CHECK:\n" + "\n".join(f"{i}. {q}" for i, q in enumerate(checks, 1))),
        F.lit("Reply with one JSON object in a json fence:\n" + _keys(names)),
    )
    # the prompt is put together below the explode, once and not once per verifier
    asked = rows.select(
        "generator_model", "line_no", "perturbation_class", "intensity", branch.alias("branch"), prompt.alias("prompt"),
        (literal_array(verifiers) if pending is None else col(pending)).alias("_asked"), *keep,
    )
    keyed = asked.select(
        "generator_model", "line_no", "perturbation_class", "intensity", "branch", "prompt", F.explode("_asked").alias("verifier_model"), *keep
    )
    return keyed.select(request_id("verify", "generator_model", "line_no", "verifier_model").alias("request_id"), *keyed.columns)


def answer_requests(
    samples: DataFrame, models: Sequence[str], family: str = "single", pending: DataFrame | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Prompt per (sample, model): answer from the text alone or reply with one code.

    ``pending`` is a work list from ``remaining``; without it every pair is asked.
    """
    rows = pending if pending is not None else evaluation_grid(samples, models)
    if family == "single":
        material = [_labelled("QUESTION", "query"), F.lit("CONTEXT:"), col("context")]
    else:
        material = [_labelled("QUESTION", "question"), F.lit("SEARCH RESULTS:"), format_passages("grounding")]
    rules = "Cite passages as [1], [2]." if family == "multi" else "Answer in a few words."
    codes = "\n".join(f"{code} - {when}" for code, when in REFUSALS.items())
    prompt = _block(
        "Answer the question only from the text given here. " + rules,
        "If no faithful answer is possible, reply with exactly one of these codes and nothing else:", codes, *material, "ANSWER:",
    )
    return rows.select(request_id("answer", "sample_id", "model_id").alias("request_id"), "sample_id", "model_id", prompt.alias("prompt"), *keep)


NO_REFERENCE = "[none provided; the question may be unanswerable]"


def judge_requests(answered: DataFrame, family: str = "single") -> DataFrame:
    """Prompt per model answer: what kind of reply is it, and how good.

    single: ``references`` (array, may be null); multi: ``is_answerable`` chooses between
    scoring the answer and judging the refusal.
    """
    kinds = ", ".join((vocab.ATTEMPT, *vocab.REFUSAL_CODES))
    if family == "single":
        known = F.coalesce(F.size("references"), F.lit(0)) > 0
        branch = F.when(known, "references").otherwise("no_references")
        prompt = _block(
            "Classify the model's reply and grade it.", f"CLASSES: {kinds}",
            "GRADES: 1 irrelevant, 2 agrees with the references but misses the question, 3 relevant with errors, 4 right but wordy, 5 right.",
            _labelled("QUESTION", "query"), _labelled("REPLY", "model_raw_output"),
            F.concat(F.lit("REFERENCES: "), F.when(known, F.array_join("references", "\n")).otherwise(NO_REFERENCE)),
            "Answer in these lines:\nCLASSIFICATION: <class>\nQUALITY_SCORE: <1-5, or N/A>\nEXPLANATION: <short>",
        )
    else:
        answerable = F.coalesce(col("is_answerable"), F.lit(False))
        branch = F.when(answerable, "answerable").otherwise("unanswerable")
        common = [_labelled("QUESTION", "question"), _labelled("REPLY", "model_answer"), F.lit("ALL PASSAGES:"), format_passages("grounding")]
        chosen = relevant()
        right = F.when(F.size(chosen) > 0, format_passages(chosen)).otherwise("No relevant passages identified")
        scored = _block(
            "Classify the model's reply and score it.", f"CLASSES: {kinds}", *common, _labelled("REFERENCE ANSWER", "answer_generate"),
            F.lit("RELEVANT PASSAGES:"), right,
            "Answer in these lines, N/A for a refusal:\nCLASSIFICATION: <class>\nELIGIBILITY: <1 if it answers what was meant, else 0>\n"
            "FACTUALITY_ALL: <1 if all passages support every claim, else 0>\nFACTUALITY_RELEVANT: <the same for the relevant passages>\nEXPLANATION: <short>",
        )
        refused = _block(
            "The question cannot be answered. Classify the model's reply.", f"CLASSES: {kinds}", _labelled("EXPECTED", "expected_behavior"), *common,
            "Answer in these lines:\nCLASSIFICATION: <class>\nREFUSAL_APPROPRIATENESS: <1 if it is the expected refusal, else 0>\nEXPLANATION: <short>",
        )
        prompt = F.when(answerable, scored).otherwise(refused)
    return answered.select(request_id("judge", "sample_id", "model_id").alias("request_id"), "sample_id", "model_id", branch.alias("branch"), prompt.alias("prompt"))
