"""Checked queries over request tables: keys, branches and required contents."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from checks.metric_queries import MODELS
from checks.record_queries import BASE, CELLS, instances, records
from checks.registry import Data, query
from demur.functions.columns import col
from demur.operators import passages as P
from demur.operators import prompts as T
from demur.sources import catalogue as C
from demur.sources import wording as WD

N_LEVERS = """CASE WHEN intensity = 'LOW' THEN CASE perturbation_class WHEN 'P-Contradiction' THEN 8 WHEN 'P-MissingInfo' THEN 9 WHEN 'P-EpistemicMismatch' THEN 9 ELSE 10 END
  WHEN intensity = 'MEDIUM' THEN CASE perturbation_class WHEN 'P-Ambiguity' THEN 9 WHEN 'P-MissingInfo' THEN 11 ELSE 10 END ELSE 10 END"""


@query("lever_catalogue", f"""WITH v AS (SELECT CASE WHEN line_no % 10 = 9 THEN 'P-Unheard' ELSE perturbation_class END AS perturbation_class, intensity FROM verifications)
SELECT perturbation_class, intensity, count(*) AS n, CASE WHEN perturbation_class <> 'P-Unheard' THEN CAST({N_LEVERS} AS BIGINT) END AS levers, perturbation_class <> 'P-Unheard' AS valid,
  CASE WHEN perturbation_class = 'P-Unheard' THEN 'unknown cell P-Unheard ' || intensity END AS cell_error FROM v GROUP BY ALL""")
def _(d: Data):
    cls = F.when(col("line_no") % 10 == 9, "P-Unheard").otherwise(col("perturbation_class"))
    rows = C.with_levers(d.votes().withColumn("perturbation_class", cls)).withColumn("valid", C.is_valid_cell())
    return rows.groupBy("perturbation_class", "intensity", "levers", "valid", "cell_error").agg(F.count(F.lit(1)).alias("n"))


@query("lever_menu", f"""SELECT generator_model, line_no, verifier_model, CAST({N_LEVERS} AS INT) AS entries, CAST({N_LEVERS} AS INT) - 1 AS breaks FROM verifications""")
def _(d: Data):
    menu = C.lever_menu(C.catalogue(d.spark))
    breaks = F.length("menu") - F.length(F.replace("menu", F.lit("\n"), F.lit("")))
    return d.votes().join(F.broadcast(menu), ["perturbation_class", "intensity"]).select("generator_model", "line_no", "verifier_model", "entries", breaks.alias("breaks"))


@query("answer_display", """SELECT line_no, CASE line_no % 3 WHEN 0 THEN '"' || answer || '"' WHEN 1 THEN '"' || answer || '" OR "b"' ELSE '"' || answer || '" OR "b" OR "c"' END AS every,
  CASE line_no % 3 WHEN 0 THEN '"' || answer || '"' WHEN 1 THEN '"' || answer || '" OR "b"' ELSE '"' || answer || '" OR "b" (and 1 other valid answers)' END AS at_most_two FROM base_instances""")
def _(d: Data):
    some = F.slice(F.array("answer", F.lit("b"), F.lit("c")), F.lit(1), (col("line_no") % 3 + 1).cast("int"))
    return d.fixture("base_instances").select("line_no", T.answer_display(some).alias("every"), T.answer_display(some, 2).alias("at_most_two"))


def has(c: str):
    return F.contains("prompt", c)


def occurrences(c: str, *texts: str):
    """How often any of some texts that cannot overlap occurs. A pattern that starts with plain characters is searched for
    in leaps and once for all texts; ``replace`` compares at every byte of a prompt, and ``length`` looks at all of them again."""
    start = os.path.commonprefix(texts)
    pattern = re.escape(start) + "(?:" + "|".join(re.escape(t[len(start):]) for t in texts) + ")"
    return F.regexp_count(c, F.lit(pattern)).cast("long")


@query("generator_requests", f"""WITH {BASE}, {CELLS} SELECT md5('generate|' || qid || '|' || perturbation_class || '|' || intensity) AS request_id, qid AS source_qid, line_no AS source_line, perturbation_class, intensity,
  CASE WHEN intensity = 'LOW' THEN 'kept' ELSE 'prevented' END || CASE WHEN line_no % 2 = 0 THEN '_one' ELSE '_several' END AS branch, TRUE AS complete FROM bi, cells""")
def _(d: Data):
    several = instances(d).withColumn("answers", F.when(col("line_no") % 2 == 0, col("answers")).otherwise(F.array_append("answers", F.lit("other"))))
    out = T.generator_requests(several, keep=("context",))
    complete = has(col("context"))
    return out.select("request_id", "source_qid", "source_line", "perturbation_class", "intensity", "branch", complete.alias("complete"))


def multi_records(d: Data):
    return P.split_passages(records(d)).withColumns({
        "qid": col("sample_id"), "line_no": col("k"), "question": F.concat(F.lit("question "), "sample_id"), "answer_generate": F.concat(F.lit("answer "), "sample_id"),
    })


@query("generator_requests_multi", f"""WITH q AS (SELECT sample_id, count(*) AS n FROM grounding_passages GROUP BY sample_id), {CELLS}
SELECT sample_id AS source_qid, perturbation_class, intensity, CASE WHEN intensity = 'LOW' THEN 'kept' ELSE 'prevented' END AS branch, perturbation_class = 'P-Ambiguity' AS noted, n AS passages FROM q, cells""")
def _(d: Data):
    out = T.generator_requests(multi_records(d), "multi")
    return out.select(
        "source_qid", "perturbation_class", "intensity", "branch", has(F.lit(T.AMBIGUITY_NOTE)).alias("noted"),
        occurrences("prompt", "  Passage S", "  Passage N").alias("passages"),
    )


@query("verifier_requests", """SELECT md5('verify|' || generator_model || '|' || line_no || '|' || v) AS request_id, generator_model, line_no, v AS verifier_model,
  CASE WHEN intensity = 'LOW' THEN 'kept' ELSE 'prevented' END AS branch, TRUE AS complete
FROM verifications, (VALUES ('claude'), ('nova'), ('gpt'), ('deepseek')) t(v) WHERE line_no % 9 <> 0 AND line_no % 8 <> 0""")
def _(d: Data):
    n = col("line_no")
    log = d.votes().drop("verifier_model").withColumns({
        "generation_successful": n % 9 != 0, "original_query": F.when(n % 8 != 0, col("original_query"))
    })
    out = T.verifier_requests(log, keep=("perturbed_query", "original_context"))
    complete = has(col("perturbed_query")) & has(col("original_context")) & has(F.lit("final_ground_truth_label"))
    return out.select("request_id", "generator_model", "line_no", "verifier_model", "branch", complete.alias("complete"))


@query("answer_requests", f"""WITH {BASE} SELECT md5('answer|' || qid || '|' || m) AS request_id, qid AS sample_id, m AS model_id, TRUE AS complete FROM bi, (VALUES {", ".join(f"('{m}')" for m in MODELS)}) t(m)""")
def _(d: Data):
    samples = instances(d).withColumnRenamed("qid", "sample_id")
    out = T.answer_requests(samples, MODELS, keep=("query", "context"))
    complete = has(col("query")) & has(col("context"))
    for code in T.REFUSALS:
        complete = complete & has(F.lit(code))
    return out.select("request_id", "sample_id", "model_id", complete.alias("complete"))


@query("judge_requests", """SELECT md5('judge|' || sample_id || '|' || model_id) AS request_id, sample_id, model_id, CASE WHEN is_answerable THEN 'references' ELSE 'no_references' END AS branch, TRUE AS complete FROM eval_results""")
def _(d: Data):
    rows = d.results().select(
        "sample_id", "model_id", F.concat(F.lit("what about "), "sample_id").alias("query"), col("model_predicted_type").alias("model_raw_output"),
        F.when(col("is_answerable"), F.array(F.concat(F.lit("it is "), "sample_id"))).alias("references"),
    )
    out = T.judge_requests(rows)
    reference = F.when(col("branch") == "references", has(F.concat(F.lit("it is "), "sample_id"))).otherwise(has(F.lit(T.NO_REFERENCE)))
    complete = has(F.concat(F.lit("what about "), "sample_id")) & reference
    return out.select("request_id", "sample_id", "model_id", "branch", complete.alias("complete"))


@query("judge_requests_multi", """WITH r AS (SELECT sample_id, CAST(substring(sample_id, 2) AS BIGINT) AS k, count(*) FILTER (WHERE evidence_correct = 'ANSWER-THE-QUESTION') AS s, count(*) AS n FROM grounding_passages GROUP BY sample_id)
SELECT sample_id, 'model_x' AS model_id, CASE WHEN k % 3 = 0 THEN 'answerable' ELSE 'unanswerable' END AS branch, n + CASE WHEN k % 3 = 0 THEN s ELSE 0 END AS blocks,
  k % 3 = 0 AND s = 0 AS none_relevant FROM r""")
def _(d: Data):
    rows = multi_records(d).withColumns({
        "model_id": F.lit("model_x"), "model_answer": F.lit("an answer"), "is_answerable": col("k") % 3 == 0, "expected_behavior": F.lit("REFUSE_OTHER")
    })
    return T.judge_requests(rows, "multi").select(
        "sample_id", "model_id", "branch", F.regexp_count("prompt", F.lit(r"(?m)^\[\d+\] ")).cast("long").alias("blocks"),
        has(F.lit("No relevant passages identified")).alias("none_relevant"),
    )


AT = "(line_no % 60)"  # days after the first version; the second is valid from day 20, the third from day 45
N_OF = f"CASE WHEN {AT} < 20 THEN {N_LEVERS} WHEN {AT} < 45 THEN least({N_LEVERS}, 8) ELSE 1 END"


def wordings(d: Data):
    """Three versions: as in the code; eight levers a cell at most and other criteria; one lever a cell."""
    path = d.scratch()
    first = T.default_wording(d.spark)
    second = first.filter("lever_no <= 8").withColumn("criteria", F.concat(F.lit("second criteria of "), "perturbation_class"))
    third = first.filter("lever_no = 1").withColumns({"name": F.lit("Only Lever"), "strategy": F.lit("third strategy")})
    for name, words, day in (("v3", third, "2024-02-15"), ("v1", first, "2024-01-01"), ("v2", second, "2024-01-21"), ("v2", third, "2023-01-01")):
        WD.publish(words, path, name, f"{day} 00:00:00")
    return WD.read(d.spark, path)


def dated(df, line: str = "line_no"):
    return df.withColumn("asked_at", F.timestamp_add("day", (col(line) % 60).cast("int"), F.lit("2024-01-01").cast("timestamp")))


@query("wording_versions", f"""WITH {BASE}, {CELLS} SELECT qid AS source_qid, perturbation_class, intensity, CASE WHEN {AT} < 20 THEN 'v1' WHEN {AT} < 45 THEN 'v2' ELSE 'v3' END AS wording_version,
  CAST({N_OF} AS BIGINT) AS entries, {AT} >= 20 AND {AT} < 45 AS second_criteria, {AT} >= 45 AS only_lever FROM bi, cells""")
def _(d: Data):
    """Rewriting requests of one run, each worded in the version valid on its day."""
    words = wordings(d)
    asked = WD.as_of(dated(instances(d)), words, "asked_at")
    out = T.generator_requests(asked, wording=words)
    return out.select(
        "source_qid", "perturbation_class", "intensity", "wording_version", occurrences("prompt", ". **").alias("entries"),
        has(F.concat(F.lit("CRITERIA: second criteria of "), "perturbation_class", F.lit("\n"))).alias("second_criteria"), has(F.lit("1. **Only Lever.**")).alias("only_lever"),
    )


@query("wording_versions_verifier", f"""SELECT generator_model, line_no, v AS verifier_model, perturbation_class, intensity, CASE WHEN {AT} < 20 THEN 'v1' WHEN {AT} < 45 THEN 'v2' ELSE 'v3' END AS wording_version,
  CAST({N_OF} AS BIGINT) AS entries FROM verifications, (VALUES ('claude'), ('nova')) t(v)""")
def _(d: Data):
    """Verification requests worded in the version that the rewrite was asked for in."""
    words = wordings(d)
    asked = WD.as_of(dated(d.votes().drop("verifier_model")), words, "asked_at")
    out = T.verifier_requests(asked, ("claude", "nova"), wording=words)
    return out.select("generator_model", "line_no", "verifier_model", "perturbation_class", "intensity", "wording_version", occurrences("prompt", ". **").alias("entries"))
