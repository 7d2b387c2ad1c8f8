"""Checked end-to-end plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.metric_queries import FRONTIER, MULTI, board_sql, multi
from checks.record_queries import DONE, TYPE, VALID, log_of_cells, samples, texts
from checks.registry import Data, query
from checks.vote_queries import COMMON, KEPT, TASK, W, _counter, exact, originals, sample_sql
from demur.functions.columns import col
from demur.functions.keys import content_key, multi_content_fields
from demur.operators import metrics as M
from demur.operators import voting as V
from demur.plans import curation, datasets, evaluation, reports, rewriting
from demur.sources import readers, sinks, tables


@query("leaderboard_from_counts", board_sql())
def _(d: Data):
    return reports.metric_tables(M.condense(d.results()))["leaderboard"]


@query("metric_report", board_sql("SELECT model_id, answer_accuracy, refusal_accuracy, hierarchical_refusal_score, total_instances FROM board"))
def _(d: Data):
    path = d.scratch()
    reports.write_metric_report(d.results(), path)
    schema = "model_id string, answer_accuracy double, refusal_accuracy double, calibrated_refusal_score double, false_refusal_rate double, missed_refusal_rate double, overall_refusal_rate double, refusal_precision double, refusal_recall double, refusal_detection_f1 double, category_accuracy double, hierarchical_refusal_score double, total_instances bigint, answerable_instances bigint, unanswerable_instances bigint"
    back = d.spark.read.schema(schema).option("header", True).csv(f"{path}/leaderboard")
    return back.select("model_id", "answer_accuracy", "refusal_accuracy", "hierarchical_refusal_score", "total_instances")


@query("stratified_dataset", sample_sql() + """SELECT l.generator_model, l.source_qid, l.perturbed_query, l.perturbed_context, s.stratum AS stratum_key
FROM samp s JOIN last l ON l.generator_model = s.generator_model AND l.content_key = s.content_key AND l.verifier_model = 'claude'""")
def _(d: Data):
    return datasets.stratified_dataset(d.votes()).select("generator_model", "source_qid", "perturbed_query", "perturbed_context", "stratum_key")


@query("common_dataset", COMMON + f"""SELECT c.generator_model, l.perturbed_query, {TASK.replace('source_qid', 'l.source_qid').replace('perturbation_class', 'l.perturbation_class').replace('intensity', 'l.intensity')} AS task_id
FROM common c JOIN last l ON l.generator_model = c.generator_model AND l.content_key = c.content_key AND l.verifier_model = 'claude'
WHERE c.task_key IN (SELECT task_key FROM (SELECT DISTINCT task_key FROM common) ORDER BY md5('42:' || task_key), task_key LIMIT 40)""")
def _(d: Data):
    return datasets.common_dataset(d.votes(), n=40).select("generator_model", "perturbed_query", "task_id")


RKEY = exact("source_qid", "perturbation_class", "intensity", "lever_selected", "line_no % 1000000000").replace("length(line_no % 1000000000)", "length(CAST(line_no % 1000000000 AS STRING))")
RPRE = "concat_ws('_', 'RB', source_qid, perturbation_class, intensity, substring(md5(concat_ws('|||', perturbed_query, perturbed_context, '', lever_selected)), 1, 8))"


@query("reference_dataset", f"""WITH lr AS (SELECT * FROM (SELECT *, md5({RKEY}) AS ck, row_number() OVER (PARTITION BY generator_model, verifier_model, {RKEY} ORDER BY line_no DESC) AS rn FROM verifications) WHERE rn = 1),
g AS (SELECT generator_model, ck FROM lr GROUP BY ALL HAVING count(*) = 4 AND count(*) FILTER (WHERE verification_successful) > 0
  AND count(*) FILTER (WHERE verification_result = 'PASS') > count(*) FILTER (WHERE verification_successful) / 2),
b AS (SELECT lr.* FROM lr JOIN g ON g.generator_model = lr.generator_model AND g.ck = lr.ck WHERE verifier_model = 'claude'),
f AS (SELECT b.*, o.answer, o.doc1, {RPRE} AS pre FROM b JOIN originals o ON o.qid = b.source_qid), n AS (SELECT *, {_counter('pre', 'ck')} AS c FROM f)
SELECT generator_model, pre || '_' || CASE WHEN c < 1000 THEN lpad(CAST(c AS STRING), 4, '0') ELSE CAST(c AS STRING) END AS unique_id, perturbed_query AS query, answer,
  perturbed_context || CASE WHEN doc1 IS NULL THEN '' ELSE '#' || doc1 END AS docs FROM n""")
def _(d: Data):
    votes = d.votes().withColumn("source_line", col("line_no") % 1000000000)
    return datasets.reference_dataset(votes, originals(d), "majority_agree").select(
        "generator_model", "unique_id", "query", "answer", F.array_join("retrieved_docs", "#").alias("docs")
    )


@query("filtered_votes", W + f""", {KEPT} SELECT l.generator_model, l.verifier_model, count(*) AS n, CAST(sum(l.line_no) AS BIGINT) AS lines
FROM kept k JOIN last l ON l.generator_model = k.generator_model AND l.content_key = k.content_key GROUP BY ALL""")
def _(d: Data):
    path = d.scratch()
    votes = d.votes()
    datasets.write_filtered_votes(votes, V.unanimous_filter(V.align(votes)), path)
    back = d.spark.read.schema("line_no bigint, generator_model string, verifier_model string").json(path)
    return back.groupBy("generator_model", "verifier_model").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("lines"))


@query("next_answers", """SELECT md5('answer|s' || o_orderkey || '|' || m) AS request_id, 's' || o_orderkey AS sample_id, m AS model_id FROM orders, (VALUES ('model_0'), ('model_2'), ('model_9')) t(m)
WHERE o_orderkey % 10 <> 0 AND ('s' || o_orderkey, m) NOT IN (SELECT (sample_id, model_id) FROM eval_results WHERE model_predicted_type <> 'REFUSE_OTHER')""")
def _(d: Data):
    rows = samples(d).withColumn("context", F.when(F.regexp_extract("sample_id", r"\d+", 0).cast("long") % 10 != 0, "some context"))
    done = d.results().filter("model_predicted_type <> 'REFUSE_OTHER'")
    return evaluation.next_answers(rows, done, ["model_0", "model_2", "model_9"]).select("request_id", "sample_id", "model_id")


@query("results_from_replies", """WITH c AS (SELECT *, CASE WHEN k % 19 = 0 THEN 'ERROR' WHEN response LIKE 'CLASSIFICATION:%' THEN trim(regexp_extract(response, '(?m)^CLASSIFICATION:(.*)$', 1))
  ELSE coalesce(nullif(upper(regexp_extract(response, 'refuse_[a-z_]+', 0)), ''), 'answer_attempt') END AS t, TRY_CAST(nullif(trim(regexp_extract(response, '(?m)^QUALITY_SCORE:(.*)$', 1)), 'N/A') AS DOUBLE) AS q FROM judge_responses)
SELECT model_id, sample_id, t AS model_predicted_type, CASE WHEN t = 'answer_attempt' AND is_answerable THEN q END AS answer_quality_score,
  CASE WHEN k % 19 = 0 OR (is_answerable AND t = 'answer_attempt') THEN NULL ELSE t = ground_truth_label END AS refusal_match_correct FROM c""")
def _(d: Data):
    rows = d.fixture("judge_responses").withColumn("error", F.when(col("k") % 19 == 0, "timeout"))
    return evaluation.results(rows).select("model_id", "sample_id", "model_predicted_type", "answer_quality_score", "refusal_match_correct")



@query("agreement_report", W + """SELECT generator_model, count(*) AS total_generated, count(*) FILTER (WHERE una) AS passed_filtering FROM full_groups GROUP BY generator_model""")
def _(d: Data):
    path = d.scratch()
    reports.write_agreement_report(d.votes(), path)
    schema = "generator_model string, total_generated bigint, passed_filtering bigint, filtering_efficiency double"
    return d.spark.read.schema(schema).option("header", True).csv(f"{path}/table4_efficiency").drop("filtering_efficiency")


@query("multidoc_report", "SELECT model_id, count(*) AS total_instances FROM eval_results GROUP BY model_id")
def _(d: Data):
    path = d.scratch()
    reports.write_multidoc_report(multi(d), path)
    table = d.spark.read.option("header", True).csv(f"{path}/frontier")
    return table.select("model_id", col("total_instances").cast("bigint").alias("total_instances"))


@query("cross_dataset_report", board_sql(f""", {MULTI}, {FRONTIER}, b AS (SELECT 'single' AS dataset, model_id, calibrated_refusal_score AS score FROM board UNION ALL SELECT 'multi', model_id, calibrated_refusal_score FROM mb),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, model_id) AS place FROM b)
SELECT 'leaderboards' AS name, dataset, model_id, round(score, 9) AS score FROM b UNION ALL SELECT 'top', dataset, model_id, round(score, 9) FROM r WHERE place <= 2
UNION ALL SELECT 'mean', dataset, NULL, round(avg(score), 9) FROM b GROUP BY dataset
UNION ALL SELECT 'gap', NULL, NULL, round(avg(score) FILTER (WHERE dataset = 'single') - avg(score) FILTER (WHERE dataset = 'multi'), 9) FROM b"""))
def _(d: Data):
    """Every table of the report, read back."""
    path = d.scratch()
    reports.write_cross_dataset_report(d.results(), multi(d), path, k=2)

    def table(name: str, kind: str, dataset, model, score: str):
        rows = d.spark.read.option("header", True).csv(f"{path}/{name}")
        return rows.select(F.lit(kind).alias("name"), dataset.alias("dataset"), model.alias("model_id"), F.round(col(score).cast("double"), 9).alias("score"))

    none = F.lit(None).cast("string")
    out = table("leaderboards", "leaderboards", col("dataset"), col("model_id"), "calibrated_refusal_score").unionByName(table("gap", "gap", none, none, "difference"))
    for family in ("single", "multi"):
        out = out.unionByName(table(f"top_{family}", "top", F.lit(family), col("model_id"), "calibrated_refusal_score"))
        out = out.unionByName(table(f"summary_{family}", "mean", F.lit(family), none, "mean_crs"))
    return out


@query("write_dataset", sample_sql() + "SELECT generator_model, count(*) AS sample_count FROM samp GROUP BY generator_model")
def _(d: Data):
    path = d.scratch()
    datasets.write_dataset(datasets.stratified_dataset(d.votes()), path)
    return d.spark.read.schema("generator_model string, sample_count bigint").json(f"{path}/generators")


# --- curation, several passages ------------------------------------------------------------

PART_SIG = "evidence_correct = 'ANSWER-THE-QUESTION'"
PART_DOMAIN = "CASE k % 3 WHEN 0 THEN 'Science' WHEN 1 THEN 'Health' ELSE 'Finance' END"
PART_COMPLEX = "CASE k % 5 WHEN 2 THEN 'Multi-hop' ELSE 'Simple' END"
PART_RANKED = f"""q AS (SELECT sample_id, k, count(*) AS n, bool_or({PART_SIG}) AS ans FROM part_passages GROUP BY ALL),
el AS (SELECT *, {PART_DOMAIN} AS dom FROM q WHERE {VALID} = 'YES' AND ans AND n >= 10 AND {PART_COMPLEX} = 'Simple' AND {TYPE} IN ('SLOW-CHANGING', '')),
rk AS (SELECT p.*, dom, {PART_SIG} AS sig, row_number() OVER (PARTITION BY p.sample_id, {PART_SIG} ORDER BY
  CASE WHEN evidence_cited = 'YES' THEN 0 WHEN evidence_correct = 'RELATED-INFORMATION' THEN 1 ELSE 2 END, idx) AS r,
  least(5, count(*) FILTER (WHERE {PART_SIG}) OVER (PARTITION BY p.sample_id)) AS s FROM part_passages p JOIN el USING (sample_id)),
comp AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY sample_id) AS m FROM rk WHERE CASE WHEN sig THEN r <= 5 ELSE r <= 10 - s END) WHERE m = 10),
one AS (SELECT sample_id, dom, string_agg(passage, '#' ORDER BY idx) AS texts,
  count(*) FILTER (WHERE sig) || '_signal_' || count(*) FILTER (WHERE NOT sig) || '_noise' AS strategy FROM comp GROUP BY ALL)"""


def part_records(d: Data):
    e = F.array_sort(F.collect_list(F.struct("idx", "passage", "evidence_correct", "evidence_cited")))
    return (
        d.fixture("part_passages").groupBy("sample_id", "k").agg(e.alias("e"))
        .select(
            "sample_id", "k", F.transform("e", lambda x: F.create_map(F.concat(F.lit("cite_"), (x["idx"] + 1).cast("string")), x["passage"])).alias("grounding"),
            col("e.evidence_correct").alias("evidence_correct"), col("e.evidence_cited").alias("evidence_cited"), col("e.evidence_cited").alias("evidence_relevant"),
            F.expr(VALID).alias("answer_validate"), F.expr(PART_COMPLEX).alias("question_complexity"), F.expr(TYPE).alias("question_type"),
            F.expr(PART_DOMAIN).alias("question_category"),
        )
    )


@query("curated_dataset", f"""WITH {PART_RANKED} SELECT sample_id, dom AS question_category, texts, strategy FROM (SELECT *, row_number() OVER (PARTITION BY dom ORDER BY md5('42:' || sample_id), sample_id) AS rn FROM one)
WHERE rn <= 20 AND dom IN ('Science', 'Health', 'Business & Industrial', 'Law & Government', 'Finance')""")
def _(d: Data):
    """Ten passages, at most five of them signal."""
    return curation.curated_dataset(part_records(d)).select(
        "sample_id", "question_category", texts("grounding").alias("texts"), col("curation_notes.normalization_strategy").alias("strategy")
    )


def multi_votes(d: Data):
    """The votes in the reversible multi-document form: two passages, the first one patched."""
    v = d.votes()

    def patch(c):
        return F.array(F.struct(F.lit(0).alias("original_index"), c.alias("perturbed_text")))

    data = F.struct(
        F.concat(F.lit("s"), (col("line_no") % 1000000000).cast("string")).alias("sample_id"), col("original_query").alias("question"),
        F.array(F.create_map(F.lit("cite_1"), col("original_context")), F.create_map(F.lit("cite_2"), F.lit("other"))).alias("grounding"),
    )
    return v.withColumns({
        "original_data": data, "perturbed_signal_passages": patch(col("perturbed_context")),
        "perturbed_noise_passages": F.array().cast("array<struct<original_index:int,perturbed_text:string>>"),
        "passage_mapping": F.struct(F.array(F.lit(0)).alias("signal_indices"), F.array(F.lit(1)).alias("noise_indices")),
        "parsing_successful": F.lit(True), "expected_rag_behavior": F.lit("x"),
    })


_SIGNAL = """'[{"original_index":0,"perturbed_text":"' || perturbed_context || '"}]'"""
MULTI = exact("source_qid", "perturbed_query", _SIGNAL, "'[]'", "perturbation_class", "intensity", "lever_selected")
MKEY = f"""concat_ws('_', 'RB', generator_model, source_qid, perturbation_class, intensity,
  substring(md5(concat_ws('|||', perturbed_query, {_SIGNAL}, '[]', generator_model)), 1, 8)) || '_0001'"""


MULTI_SAMPLE = f"""WITH last AS (SELECT * FROM (SELECT *, md5({MULTI}) AS ck, row_number() OVER (PARTITION BY generator_model, verifier_model, md5({MULTI}) ORDER BY line_no DESC) AS rn
  FROM verifications) WHERE rn = 1),
kept AS (SELECT generator_model, ck, any_value(perturbation_class) || '_' || any_value(intensity) AS stratum FROM last GROUP BY ALL HAVING count(*) = 4 AND count(*) FILTER (WHERE verification_result = 'PASS') = 4),
q AS (SELECT *, md5('42:' || ck) AS hh, row_number() OVER (PARTITION BY generator_model, stratum ORDER BY md5('42:' || ck), ck) AS a FROM kept),
t AS (SELECT *, count(*) FILTER (WHERE a <= 22) OVER (PARTITION BY generator_model) AS taken, row_number() OVER (PARTITION BY generator_model, a <= 22 ORDER BY hh, ck) AS b FROM q),
samp AS (SELECT * FROM t WHERE a <= 22 OR b <= 400 - taken)
SELECT 's' || line_no AS sample_id, perturbed_query AS question, perturbed_context || '#other' AS texts, original_query AS original_question, {MKEY} AS unique_id, stratum AS stratum_key
FROM (SELECT l.*, s.stratum FROM samp s JOIN last l ON l.generator_model = s.generator_model AND l.ck = s.ck AND l.verifier_model = 'claude')"""


@query("stratified_dataset_multi", MULTI_SAMPLE)
def _(d: Data):
    return datasets.multi_dataset(multi_votes(d)).select(
        "sample_id", "question", texts("grounding").alias("texts"), "original_question", col("stratified_metadata.unique_id").alias("unique_id"),
        col("stratified_metadata.stratum_key").alias("stratum_key"),
    )


@query("content_id_multi", f"SELECT generator_model, verifier_model, line_no, md5({MULTI}) AS content_key FROM verifications")
def _(d: Data):
    return multi_votes(d).select("generator_model", "verifier_model", "line_no", content_key(multi_content_fields()).alias("content_key"))


def multi_log(d: Data):
    """The votes as verifiers log them: the reversible nested record of ten passages with the verdict."""
    v = multi_votes(d)
    more = [F.create_map(F.lit(f"cite_{k}"), F.lit(f"other {k}")) for k in range(3, 11)]
    flags = ("lever_correctly_implemented", "intensity_correctly_achieved", "uncertainty_successfully_induced")
    return v.select(
        "line_no", col("original_data").withField("grounding", F.concat("original_data.grounding", F.array(*more))).alias("original_data"),
        F.struct(F.array(F.lit(0)).alias("signal_indices"), F.array(*map(F.lit, range(1, 10))).alias("noise_indices")).alias("passage_mapping"),
        F.struct("perturbation_class", "intensity", F.lit(True).alias("generation_successful"), "source_qid").alias("perturbation_metadata"),
        F.struct(
            "perturbed_query", "perturbed_signal_passages", "perturbed_noise_passages", "lever_selected", F.lit("x").alias("expected_rag_behavior"),
            F.lit(True).alias("parsing_successful"),
        ).alias("perturbation_results"),
        "verification_successful", F.when(col("verification_successful"), F.struct("verification_result", *flags)).alias("verification_response"),
        "generator_model", "verifier_model",
    )


def logged(d: Data) -> str:
    """Logs of every generator and verifier, each in two drops: the second one's records have fields that the first one's lack."""
    root = d.scratch()
    rows = multi_log(d)
    for g in ("claude", "deepseek", "gpt", "nova"):
        for v in ("claude", "nova", "gpt", "deepseek"):
            own = rows.filter((col("generator_model") == g) & (col("verifier_model") == v)).drop("generator_model", "verifier_model")
            path = f"{root}/dataset_{g}/multi_verifications_{v}.jsonl"
            own.filter("line_no % 2 = 0").write.json(path, compression="gzip")
            own.filter("line_no % 2 = 1").withColumns({"note": F.lit("new"), "verification_model": F.lit(v)}).write.mode("append").json(path, compression="gzip")
    return root


@query("read_verifications_multi", """SELECT generator_model, verifier_model, line_no, source_qid, original_query, perturbed_query, perturbation_class, intensity, lever_selected,
  verification_successful, verification_result, perturbed_context AS patch, CAST(10 AS INT) AS passages, CASE WHEN line_no % 2 = 1 THEN verifier_model END AS verification_model FROM verifications""")
def _(d: Data):
    back = readers.read_multi_verifications(d.spark, logged(d), numbered=False)
    return back.select(
        "generator_model", "verifier_model", "line_no", "source_qid", "original_query", "perturbed_query", "perturbation_class", "intensity", "lever_selected",
        "verification_successful", "verification_result", col("perturbed_signal_passages")[0]["perturbed_text"].alias("patch"),
        F.size("original_data.grounding").alias("passages"), "verification_model",
    )


_OTHERS = "#other" + "".join(f"#other {k}" for k in range(3, 11))


@query("unified_record_multi", MULTI_SAMPLE.replace("|| '#other' AS texts", f"|| '{_OTHERS}' AS texts"))
def _(d: Data):
    """From log files to the published record, ten passages each."""
    votes = readers.read_multi_verifications(d.spark, logged(d), numbered=False)
    return datasets.multi_dataset(votes).select(
        "sample_id", "question", texts("grounding").alias("texts"), "original_question", col("stratified_metadata.unique_id").alias("unique_id"),
        col("stratified_metadata.stratum_key").alias("stratum_key"),
    )


VERDICT = "verification_result string, lever_correctly_implemented boolean, intensity_correctly_achieved boolean"


@query("verification_log", """SELECT generator_model, verifier_model, line_no, verification_successful, verification_result, lever_correctly_implemented,
  CASE WHEN verification_successful THEN NULL ELSE 'timeout' END AS verification_error FROM verifications""")
def _(d: Data):
    """Requests, replies of which some failed first, votes appended in two batches by a job that runs twice, read again."""
    votes = d.votes()
    ident = F.concat_ws("|", "generator_model", "verifier_model", col("line_no").cast("string"))
    requests = votes.select(ident.alias("request_id"), "generator_model", "verifier_model", "line_no")
    text = F.concat(F.lit("```json\n"), F.to_json(F.struct(*[f.split()[0] for f in VERDICT.split(", ")])), F.lit("\n```"))
    ok = col("verification_successful")
    last = votes.select(ident.alias("request_id"), F.when(ok, text).alias("response"), F.when(~ok, "timeout").alias("error"), F.lit(2).alias("seq"))
    first = last.filter("length(request_id) % 2 = 0").select("request_id", F.lit(None).cast("string").alias("response"), F.lit("busy").alias("error"), F.lit(1).alias("seq"))
    log, path = rewriting.verification_log(requests, last.unionByName(first), VERDICT), d.scratch()
    for name, part in 2 * (("even", log.filter("line_no % 2 = 0")), ("odd", log.filter("line_no % 2 = 1"))):
        sinks.append_results(part, path, batch=name)
    return readers.flatten_verdict(tables.read_batches(d.spark, path)).select(
        "generator_model", "verifier_model", "line_no", "verification_successful", "verification_result", "lever_correctly_implemented", "verification_error"
    )


# --- generation and verification -----------------------------------------------------------


@query("next_generations", f"WITH {DONE} SELECT md5('generate|gpt|' || qid || '|' || perturbation_class || '|' || intensity) AS request_id, qid AS source_qid, perturbation_class, intensity, 'gpt' AS generator_model FROM mc")
def _(d: Data):
    ins, done = log_of_cells(d)
    ins = ins.withColumns({"query": F.lit("what?"), "context": F.lit("a text"), "answers": F.array(F.lit("yes"))})
    log = done.unionByName(done.withColumn("generator_model", F.lit("nova")))
    return rewriting.next_generations(ins, log, "gpt").select("request_id", "source_qid", "perturbation_class", "intensity", "generator_model")


@query("next_verifications", """SELECT DISTINCT md5('verify|' || generator_model || '|' || line_no || '|' || v) AS request_id, generator_model, line_no, v AS verifier_model
FROM verifications c, (VALUES ('claude'), ('nova'), ('gpt'), ('deepseek')) t(v)
WHERE NOT EXISTS (SELECT 1 FROM verifications d WHERE d.generator_model = c.generator_model AND d.perturbed_query = c.perturbed_query AND d.verifier_model = v AND d.verification_successful)""")
def _(d: Data):
    votes = d.votes()
    left = rewriting.next_verifications(votes.drop("verifier_model"), votes.filter("verification_successful"))
    return left.select("request_id", "generator_model", "line_no", "verifier_model").distinct()


GENERATED = "perturbed_query string, lever_selected string, intensity_achieved string"


@query("generation_log", """SELECT 'r' || id AS request_id, id % 3 <> 2 AND shape <> 3 AND shape <> 4 AS generation_successful, CASE WHEN id % 3 <> 2 AND shape <> 3 AND shape <> 4 THEN p_name END AS perturbed_query
FROM json_responses JOIN part ON p_partkey = id""")
def _(d: Data):
    """Every request is answered twice: failed and then successfully, the other way round, or failed twice."""
    r = d.fixture("json_responses").withColumn("request_id", F.concat(F.lit("r"), col("id").cast("string")))
    requests = r.select("request_id", "id", F.lit("P-Ambiguity").alias("perturbation_class"), F.lit("LOW").alias("intensity"))

    def reply(seq: int, failed):
        error = F.when(failed, F.lit("timeout"))
        return r.select("request_id", F.when(~failed, col("response")).alias("response"), error.alias("error"), F.lit(seq).alias("seq"))

    replies = reply(1, col("id") % 3 != 1).unionByName(reply(2, col("id") % 3 != 0))
    return rewriting.generation_log(requests, replies, GENERATED).select("request_id", "generation_successful", "perturbed_query")
