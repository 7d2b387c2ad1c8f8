"""Checked queries over passages, base instances, replies and work lists."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from checks.metric_queries import MODELS
from checks.registry import Data, query
from demur.functions import keys as K
from demur.operators import matching as J
from demur.operators import parsing as R
from demur.operators import passages as P
from demur.operators import records as RC
from demur.operators import sampling as S
from demur.operators import unified as UN

# --- multi-document records ---------------------------------------------------------------


def records(d: Data):
    """Nested records; an order is a question and its lines are the passages."""
    e = F.array_sort(F.collect_list(F.struct("idx", "passage", "evidence_correct", "evidence_cited")))
    k = F.regexp_extract("sample_id", r"\d+", 0).cast("long")
    return (
        d.fixture("grounding_passages").groupBy("sample_id").agg(e.alias("e"))
        .select(
            "sample_id", k.alias("k"),
            F.transform("e", lambda x: F.create_map(F.concat(F.lit("cite_"), (x["idx"] + 1).cast("string")), x["passage"])).alias("grounding"),
            F.col("e.evidence_correct").alias("evidence_correct"), F.col("e.evidence_cited").alias("evidence_cited"),
            F.col("e.evidence_cited").alias("evidence_relevant"),
        )
    )


def texts(c: str):
    return F.array_join(F.transform(c, P.passage_text), "#")


def numbers(c: str):
    return F.array_join(F.transform(c, lambda i: i.cast("string")), ",")


SIG = "evidence_correct = 'ANSWER-THE-QUESTION'"
RANKED = f"""rk AS (SELECT *, {SIG} AS sig, row_number() OVER (PARTITION BY sample_id, {SIG} ORDER BY
  CASE WHEN evidence_cited = 'YES' THEN 0 WHEN evidence_correct = 'RELATED-INFORMATION' THEN 1 ELSE 2 END, idx) AS r,
  least(2, count(*) FILTER (WHERE {SIG}) OVER (PARTITION BY sample_id)) AS s FROM grounding_passages),
comp AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM rk WHERE CASE WHEN sig THEN r <= 2 ELSE r <= 4 - s END) WHERE n = 4)"""


@query("signal_noise_split", f"""SELECT sample_id, coalesce(string_agg(idx, ',' ORDER BY idx) FILTER (WHERE {SIG}), '') AS signal_indices,
  coalesce(string_agg(idx, ',' ORDER BY idx) FILTER (WHERE NOT {SIG}), '') AS noise_indices,
  coalesce(string_agg(passage, '#' ORDER BY idx) FILTER (WHERE {SIG}), '') AS signal_texts,
  coalesce(string_agg(passage, '#' ORDER BY idx) FILTER (WHERE NOT {SIG}), '') AS noise_texts FROM grounding_passages GROUP BY sample_id""")
def _(d: Data):
    return P.split_passages(records(d)).select(
        "sample_id", numbers("signal_indices").alias("signal_indices"), numbers("noise_indices").alias("noise_indices"),
        F.array_join("signal_passages", "#").alias("signal_texts"), F.array_join("noise_passages", "#").alias("noise_texts"),
    )


@query("compose_passages", f"""WITH {RANKED} SELECT sample_id, string_agg(passage, '#' ORDER BY idx) AS texts, string_agg(evidence_correct, ',' ORDER BY idx) AS correct,
  string_agg(evidence_cited, ',' ORDER BY idx) AS cited FROM comp GROUP BY sample_id""")
def _(d: Data):
    return P.compose(records(d), total=4, signal=2).select(
        "sample_id", texts("grounding").alias("texts"), F.array_join("evidence_correct", ",").alias("correct"), F.array_join("evidence_cited", ",").alias("cited")
    )


@query("curation_notes", f"""WITH {RANKED} SELECT sample_id, count(*) FILTER (WHERE sig) || '_signal_' || count(*) FILTER (WHERE NOT sig) || '_noise' AS normalization_strategy,
  4::INT AS passages_normalized_to, 'Pristine' AS status FROM comp GROUP BY sample_id""")
def _(d: Data):
    notes = F.col("curation_notes")
    return P.compose(records(d), total=4, signal=2).select(
        "sample_id", *[notes[c].alias(c) for c in ("normalization_strategy", "passages_normalized_to", "status")]
    )


@query("priority_sort", f"""SELECT sample_id, string_agg(idx, ',' ORDER BY CASE WHEN evidence_cited = 'YES' THEN 0 WHEN evidence_correct = 'RELATED-INFORMATION' THEN 1 ELSE 2 END, idx) AS ordered
FROM grounding_passages GROUP BY sample_id""")
def _(d: Data):
    every = F.transform("grounding", lambda p, i: i)
    order = P.priority_sort(every, F.col("evidence_correct"), F.col("evidence_cited"))
    return records(d).select("sample_id", order.alias("o")).select("sample_id", numbers("o").alias("ordered"))


@query("passage_text", """SELECT sample_id, idx, CASE WHEN idx % 5 <> 0 THEN passage END AS text FROM grounding_passages""")
def _(d: Data):
    cite = F.when(F.col("idx") % 5 != 0, F.lit("cite_1")).otherwise(F.lit("url"))
    padded = F.concat(F.lit(" \t"), "passage", F.lit("\n "))
    return d.fixture("grounding_passages").select("sample_id", "idx", P.passage_text(F.create_map(F.lit("title"), F.lit("a title"), cite, padded)).alias("text"))


@query("format_passages", r"""SELECT sample_id, string_agg('[' || (idx + 1) || '] ' || passage, chr(10) || chr(10) ORDER BY idx) AS shown FROM grounding_passages GROUP BY sample_id""")
def _(d: Data):
    return records(d).select("sample_id", P.format_passages().alias("shown"))


@query("relevant_passages", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, {SIG} ORDER BY idx) AS n FROM grounding_passages)
SELECT sample_id, coalesce(string_agg('[' || n || '] ' || passage, chr(10) || chr(10) ORDER BY idx) FILTER (WHERE {SIG}), 'No search results provided.') AS shown FROM r GROUP BY sample_id""")
def _(d: Data):
    return records(d).select("sample_id", P.format_passages(P.relevant()).alias("shown"))


COMPLEX = "CASE k % 5 WHEN 0 THEN 'Simple' WHEN 1 THEN 'Comparison' WHEN 2 THEN 'Multi-hop' WHEN 3 THEN 'Set' END"
TYPE = "CASE k % 4 WHEN 0 THEN 'SLOW-CHANGING' WHEN 1 THEN '' WHEN 2 THEN 'FAST-CHANGING' END"
DOMAIN = "CASE k % 6 WHEN 0 THEN 'Science' WHEN 1 THEN 'Health' WHEN 2 THEN 'Finance' WHEN 3 THEN 'Arts' WHEN 4 THEN 'Law & Government' END"
VALID = "CASE WHEN k % 7 = 0 THEN 'NO' ELSE 'YES' END"
CANDIDATE = f"""q AS (SELECT sample_id, CAST(substring(sample_id, 2) AS BIGINT) AS k, count(*) AS n, bool_or({SIG}) AS ans FROM grounding_passages GROUP BY sample_id),
el AS (SELECT *, {DOMAIN} AS dom FROM q WHERE {VALID} = 'YES' AND ans AND n >= 4 AND {COMPLEX} IN ('Simple', 'Comparison', 'Set') AND {TYPE} IN ('SLOW-CHANGING', '') AND {DOMAIN} IS NOT NULL)"""


def candidates(d: Data):
    rows = records(d).withColumns({
        "answer_validate": F.expr(VALID), "question_complexity": F.expr(COMPLEX), "question_type": F.expr(TYPE), "question_category": F.expr(DOMAIN)
    })
    return P.eligible(rows, total=4)


@query("eligibility_filter", f"WITH {CANDIDATE} SELECT sample_id, dom AS question_category FROM el")
def _(d: Data):
    return candidates(d).select("sample_id", "question_category")


@query("domain_candidates", f"""WITH {CANDIDATE} SELECT domain, count(sample_id) AS candidates FROM (VALUES ('Science'), ('Health'), ('Business & Industrial'), ('Law & Government'), ('Finance')) t(domain)
LEFT JOIN el ON dom = domain GROUP BY domain""")
def _(d: Data):
    return P.domain_candidates(candidates(d))


@query("domain_sample", f"""WITH {CANDIDATE} SELECT sample_id, dom AS question_category FROM (SELECT *, row_number() OVER (PARTITION BY dom ORDER BY md5('42:' || sample_id), sample_id) AS rn FROM el)
WHERE rn <= 20 AND dom IN ('Science', 'Health', 'Business & Industrial', 'Law & Government', 'Finance')""")
def _(d: Data):
    return S.domain_sample(candidates(d)).select("sample_id", "question_category")


@query("validate_record", """SELECT o_orderkey AS k, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'passage_mapping' END, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN 'passage_mapping.signal_indices' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'passage_mapping.noise_indices' END, CASE WHEN o_orderkey % 4 = 0 THEN 'perturbation_metadata.intensity' END) AS missing,
  NOT (o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 4 = 0) AS is_valid FROM orders""")
def _(d: Data):
    k = F.col("o_orderkey")
    nested = d.table("orders").select(
        k.alias("k"), F.struct(F.col("o_orderstatus").alias("question")).alias("original_data"),
        F.when(k % 5 != 0, F.struct(F.when(k % 3 != 0, F.array(F.lit(0))).alias("signal_indices"), F.array(F.lit(1)).alias("noise_indices"))).alias("passage_mapping"),
        F.struct(F.lit("P-Ambiguity").alias("perturbation_class"), F.when(k % 4 != 0, F.lit("LOW")).alias("intensity"), F.lit(True).alias("generation_successful")).alias("perturbation_metadata"),
        F.struct(F.lit("x").alias("perturbed_query")).alias("perturbation_results"),
    )
    return P.validate(nested).select("k", F.array_join("missing", ",").alias("missing"), "is_valid")


@query("flatten_metadata", """SELECT 's' || o_orderkey AS sample_id, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE o_orderpriority END AS question_category,
  CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE o_orderstatus END AS topic_tag, CASE WHEN o_orderkey % 6 = 0 THEN 'unknown' ELSE 'HIGH' END AS intensity,
  CASE o_orderkey % 3 WHEN 0 THEN 'REFUSE_OTHER' ELSE 'ANSWER_CORRECTLY' END AS expected_behavior, o_orderkey % 3 <> 0 AS is_answerable,
  'src' AS source_dataset, 'unknown' AS curation_status, 'gen' AS generator_model, 'unknown' AS stratum_key FROM orders""")
def _(d: Data):
    k = F.col("o_orderkey")
    null = F.lit(None).cast("string")
    nested = d.table("orders").select(
        F.concat(F.lit("s"), k.cast("string")).alias("sample_id"), F.lit("q").alias("question"), F.lit("a").alias("answer_generate"),
        F.when(k % 3 != 0, F.col("o_orderpriority")).alias("question_category"), F.when(k % 4 != 0, F.col("o_orderstatus")).otherwise("").alias("topic_tag"),
        *[null.alias(c) for c in ("question_tag", "question_type", "question_complexity", "question_popularity")],
        F.struct(F.lit("src").alias("source_dataset"), null.alias("status"), F.lit("").alias("normalization_strategy")).alias("curation_notes"),
        F.struct(
            F.lit("P-Ambiguity").alias("perturbation_class"), F.when(k % 6 != 0, F.lit("HIGH")).alias("intensity"), null.alias("lever_selected"),
            F.lit(True).alias("generation_successful"), null.alias("source_qid"),
            F.when(k % 3 == 0, "REFUSE_OTHER").when(k % 3 == 1, "").alias("expected_rag_behavior"),
        ).alias("perturbation_metadata"),
        F.struct(F.lit("gen").alias("generator_model"), *[null.alias(c) for c in ("generator_model_full", "source_folder", "unique_id", "stratum_key")]).alias("stratified_metadata"),
    )
    return RC.flatten(nested).select(
        "sample_id", "question_category", "topic_tag", "intensity", "expected_behavior", "is_answerable", "source_dataset", "curation_status", "generator_model", "stratum_key"
    )


def patched(d: Data):
    rows = P.split_passages(records(d)).withColumn("question", F.concat(F.lit("question "), "sample_id"))
    p = d.fixture("patches")
    entry = F.struct("seq", "original_index", "perturbed_text")

    def of(kind: str):
        ordered = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry)))
        return F.transform(ordered, lambda x: F.struct(x["original_index"], x["perturbed_text"])).alias(f"{kind}_patches")

    lists = p.groupBy("sample_id").agg(of("signal"), of("noise"))
    k = F.col("k")
    return P.apply_patches(
        rows.join(lists, "sample_id", "left").withColumns({
            "perturbed_query": F.when(k % 2 == 0, F.concat(F.lit("new "), "sample_id")), "parsing_successful": F.when(k % 13 != 0, k % 11 != 0)
        })
    )


@query("apply_patches", f"""WITH pos AS (SELECT *, CASE WHEN {SIG} THEN 'signal' ELSE 'noise' END AS kind, CAST(substring(sample_id, 2) AS BIGINT) AS k,
  row_number() OVER (PARTITION BY sample_id, {SIG} ORDER BY idx) - 1 AS pos FROM grounding_passages),
lp AS (SELECT sample_id, kind, original_index, arg_max(perturbed_text, seq) AS t FROM patches GROUP BY ALL),
pp AS (SELECT p.*, CASE WHEN k % 13 <> 0 AND k % 11 <> 0 THEN coalesce(t, passage) ELSE passage END AS final FROM pos p
  LEFT JOIN lp ON lp.sample_id = p.sample_id AND lp.kind = p.kind AND lp.original_index = p.pos)
SELECT sample_id, CASE WHEN any_value(k) % 13 <> 0 AND any_value(k) % 11 <> 0 AND any_value(k) % 2 = 0 THEN 'new ' ELSE 'question ' END || sample_id AS question,
  string_agg(final, '#' ORDER BY idx) AS texts FROM pp GROUP BY sample_id""")
def _(d: Data):
    return patched(d).select("sample_id", "question", texts("grounding").alias("texts"))


@query("restore_original", """SELECT sample_id, 'question ' || sample_id AS question, string_agg(passage, '#' ORDER BY idx) AS texts FROM grounding_passages GROUP BY sample_id""")
def _(d: Data):
    return P.restore(patched(d)).select("sample_id", "question", texts("grounding").alias("texts"))


# --- base instances, labels, gates -----------------------------------------------------------


def instances(d: Data, n: int | None = None):
    b = d.fixture("base_instances")

    def one(c: str):
        return F.when(F.col(c).isNotNull(), F.array(c))

    return RC.base_instances(b.withColumns({"gold_docs": one("gold_doc"), "retrieved_docs": one("retrieved_doc")}), n)


BASE = """bi AS (SELECT line_no, coalesce(qid, CAST(line_no AS STRING)) AS qid, query, coalesce(gold_doc, retrieved_doc, '') AS context, answer
  FROM base_instances WHERE query <> '' AND coalesce(gold_doc, retrieved_doc, '') <> '')"""


@query("base_instances", f"WITH {BASE} SELECT line_no, qid, query, md5(context) AS context, answer FROM bi")
def _(d: Data):
    return instances(d).select("line_no", "qid", "query", F.md5("context").alias("context"), F.array_join("answers", "|").alias("answer"))


@query("base_instances_first", f"WITH {BASE} SELECT line_no, qid FROM bi ORDER BY line_no LIMIT 100")
def _(d: Data):
    return instances(d, 100).select("line_no", "qid")


@query("limit_examples", "SELECT line_no, query FROM base_instances ORDER BY line_no LIMIT 25")
def _(d: Data):
    return RC.limit_examples(d.fixture("base_instances"), 25).select("line_no", "query")


@query("evaluation_gate", "SELECT line_no, query FROM base_instances WHERE query <> '' AND gold_doc IS NOT NULL AND gold_doc <> ''")
def _(d: Data):
    return RC.evaluation_gate(d.fixture("base_instances"), "gold_doc", "query").select("line_no", "query")


@query("ground_truth", """SELECT k, model_id, CASE WHEN k % 10 = 9 THEN NULL ELSE ground_truth_label END AS expected_label, k % 10 <> 9 AS known_class,
  CASE WHEN k % 10 = 9 THEN NULL ELSE CASE perturbation_class WHEN 'P-FalsePremise' THEN 'Query' WHEN 'P-Ambiguity' THEN 'Query<->Context' WHEN 'P-GranularityMismatch' THEN 'Query<->Context'
  WHEN 'P-EpistemicMismatch' THEN 'Query<->Context' ELSE 'Context' END END AS target FROM eval_results""")
def _(d: Data):
    cls = F.when(F.col("k") % 10 == 9, "P-Unheard").otherwise(F.col("perturbation_class"))
    return RC.ground_truth(d.results().withColumn("perturbation_class", cls)).select("k", "model_id", "expected_label", "known_class", "target")


@query("is_answerable", "SELECT count(*) FILTER (WHERE ground_truth_label = 'ANSWER_CORRECTLY') AS answerable, count(*) FILTER (WHERE ground_truth_label <> 'ANSWER_CORRECTLY') AS unanswerable FROM eval_results")
def _(d: Data):
    return RC.composition(d.results())


@query("sample_uid", "SELECT DISTINCT CASE WHEN k % 6 = 0 THEN 'unknown' ELSE sample_id END || '_' || k AS sample_uid FROM eval_results")
def _(d: Data):
    return d.results().select(K.sample_uid(F.when(F.col("k") % 6 != 0, F.col("sample_id")), "k").alias("sample_uid")).distinct()


MODEL_ID = """CASE k % 6 WHEN 0 THEN 'bedrock/us.anthropic.claude-x:0' WHEN 1 THEN 'a/nova-pro:1' WHEN 2 THEN 'openai/gpt-4o' WHEN 3 THEN 'b/c/deepseek.r1:0' WHEN 4 THEN 'v/w.x/m.' || model_id || ':7' ELSE model_id END"""
GEN_ID = """CASE k % 6 WHEN 0 THEN 'claude-sonnet-4' WHEN 1 THEN 'deepseek-r1' WHEN 2 THEN 'gpt-4o' WHEN 3 THEN 'amazon-nova-pro' WHEN 4 THEN model_id || '-large-2' ELSE model_id END"""


@query("verifier_short_name", """SELECT k, model_id, CASE k % 6 WHEN 0 THEN 'claude' WHEN 1 THEN 'nova' WHEN 2 THEN 'gpt' WHEN 3 THEN 'deepseek' WHEN 4 THEN 'm_' || model_id ELSE model_id END AS short FROM eval_results""")
def _(d: Data):
    return d.results().select("k", "model_id", K.verifier_short_name(F.expr(MODEL_ID)).alias("short"))


@query("generator_short_name", """SELECT k, model_id, CASE k % 6 WHEN 0 THEN 'claude' WHEN 1 THEN 'deepseek' WHEN 2 THEN 'gpt' WHEN 3 THEN 'nova' ELSE model_id END AS short FROM eval_results""")
def _(d: Data):
    return d.results().select("k", "model_id", K.generator_short_name(F.expr(GEN_ID)).alias("short"))


GATE = """CASE WHEN line_no % 9 = 0 THEN 'Original generation failed' WHEN line_no % 8 = 0 OR line_no % 10 = 0 THEN 'Missing required fields' {extra} END"""


@query("verification_gate", f"""SELECT 'single' AS family, generator_model, verifier_model, line_no, {GATE.format(extra='')} AS verification_error FROM verifications
UNION ALL SELECT 'multi', generator_model, verifier_model, line_no, CASE WHEN line_no % 12 = 0 THEN 'Invalid input data format' ELSE {GATE.format(extra="WHEN line_no % 7 = 0 THEN 'Generation parsing failed'")} END FROM verifications""")
def _(d: Data):
    n = F.col("line_no")
    rows = d.votes().withColumns({
        "generation_successful": n % 9 != 0, "original_query": F.when(n % 8 != 0, F.col("original_query")).otherwise(""),
        "original_context": F.when(n % 10 != 0, F.col("original_context")), "is_valid": n % 12 != 0, "parsing_successful": n % 7 != 0,
    })
    rows = rows.withColumns({"question": F.col("original_query"), "answer_generate": F.col("original_context")})
    out = ("generator_model", "verifier_model", "line_no", "verification_error")
    return RC.verification_gate(rows).select(F.lit("single").alias("family"), *out).unionByName(
        RC.verification_gate(rows, "multi").select(F.lit("multi").alias("family"), *out)
    )


@query("replace_gold_doc", "SELECT qid, 'new ' || qid || CASE WHEN doc1 IS NULL THEN '' ELSE '#' || doc1 END AS docs FROM originals")
def _(d: Data):
    docs = F.filter(F.array("doc0", "doc1"), lambda x: x.isNotNull())
    rows = d.fixture("originals").select("qid", docs.alias("retrieved_docs"), F.concat(F.lit("new "), "qid").alias("perturbed_context"))
    return rows.select("qid", F.array_join(UN.replace_gold_doc(), "#").alias("docs"))


# --- replies ---------------------------------------------------------------------------------

REPLY = "perturbed_query string, lever_selected string, intensity_achieved string"
PARSED = """pj AS (SELECT r.*, shape <> 3 AND shape <> 4 AS ok, CASE WHEN shape <> 3 AND shape <> 4 THEN p_name END AS q, CASE WHEN shape <> 3 AND shape <> 4 THEN p_type END AS lever,
  CASE WHEN shape <> 3 AND shape <> 4 THEN 'HIGH' END AS intensity FROM json_responses r JOIN part ON p_partkey = id)"""


@query("parse_fenced_json", f"""WITH {PARSED} SELECT id, ok AS parsing_successful, q AS perturbed_query, lever AS lever_selected, intensity AS intensity_achieved,
  CASE WHEN NOT ok THEN response END AS raw_response FROM pj""")
def _(d: Data):
    return R.parse_fenced_json(d.fixture("json_responses"), REPLY).select("id", "parsing_successful", "parsed.*", "raw_response")


def asked(d: Data):
    """Requests for every part; every seventh has no reply yet, every eleventh failed."""
    r = d.fixture("json_responses").withColumn("request_id", F.concat(F.lit("r"), F.col("id").cast("string")))
    failed = F.when(F.col("id") % 11 == 0, F.lit("timeout"))
    requests = r.select("request_id", "id", F.lit("P-Ambiguity").alias("perturbation_class"), F.lit("LOW").alias("intensity"), F.lit("q").alias("original_query"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("source_qid"))
    return J.attach(requests, r.filter("id % 7 <> 0").select("request_id", F.when(failed.isNull(), F.col("response")).alias("response"), failed.alias("error")))


@query("generation_result", f"""WITH {PARSED} SELECT 'r' || id AS request_id, 'q' || id AS source_qid, ok AND id % 11 <> 0 AS generation_successful,
  CASE WHEN id % 11 <> 0 THEN q END AS perturbed_query, CASE WHEN id % 11 <> 0 THEN lever END AS lever_selected,
  CASE WHEN id % 11 = 0 THEN 'timeout' WHEN NOT ok THEN 'reply is not a JSON object' END AS error FROM pj WHERE id % 7 <> 0""")
def _(d: Data):
    return R.generation_result(asked(d), REPLY).select("request_id", "source_qid", "generation_successful", "perturbed_query", "lever_selected", "error")


@query("verification_result", f"""WITH {PARSED} SELECT 'r' || id AS request_id, ok AND id % 11 <> 0 AS verification_successful, CASE WHEN id % 11 <> 0 THEN lever END AS lever,
  CASE WHEN id % 11 = 0 THEN 'timeout' WHEN NOT ok THEN 'reply is not a JSON object' END AS verification_error FROM pj WHERE id % 7 <> 0""")
def _(d: Data):
    return R.verification_result(asked(d), REPLY).select(
        "request_id", "verification_successful", F.col("verification_response.lever_selected").alias("lever"), "verification_error"
    )


@query("attach_responses", f"""SELECT 'r' || id AS request_id, CASE WHEN id % 7 = 0 OR id % 11 = 0 THEN NULL ELSE response END AS response,
  CASE WHEN id % 7 <> 0 AND id % 11 = 0 THEN 'timeout' END AS error, id % 7 = 0 AS pending FROM json_responses""")
def _(d: Data):
    return asked(d).select("request_id", "response", "error", "pending")


@query("stamped_time", "SELECT line_no, generator_model, verifier_model, TRUE AS within, 26::INT AS length FROM verifications")
def _(d: Data):
    """The provenance time lies between the start of the job and now; it is the same in all rows of a write."""
    start = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    rows = UN.stamp(d.votes())
    at = F.to_timestamp("formatted_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    earliest = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.lit(start).cast("timestamp_ntz")).cast("timestamp")
    within = (at >= earliest) & (at <= F.current_timestamp())
    return rows.select("line_no", "generator_model", "verifier_model", within.alias("within"), F.length("formatted_timestamp").alias("length"))


CODES = ("REFUSE_AMBIGUOUS_QUERY", "REFUSE_CONTRADICTORY_CONTEXT", "REFUSE_INFO_MISSING_IN_CONTEXT", "REFUSE_FALSE_PREMISE_IN_QUERY",
         "REFUSE_GRANULARITY_MISMATCH", "REFUSE_NONFACTUAL_QUERY", "REFUSE_OTHER")
FIRST_CODE = "CASE " + " ".join(f"WHEN contains(upper(response), '{c}') THEN '{c}'" for c in CODES) + " ELSE 'answer_attempt' END"


def field(label: str) -> str:
    return f"trim(regexp_extract(response, '(?m)^{label}:(.*)$', 1))"


@query("parse_judgement_lines", f"""SELECT model_id, sample_id, CASE WHEN response LIKE 'CLASSIFICATION:%' THEN {field('CLASSIFICATION')} ELSE {FIRST_CODE} END AS model_predicted_type,
  TRY_CAST(nullif({field('QUALITY_SCORE')}, 'N/A') AS DOUBLE) AS judge_quality_score,
  CASE WHEN response LIKE 'CLASSIFICATION:%' THEN {field('EXPLANATION')} WHEN {FIRST_CODE} = 'answer_attempt' THEN 'unreadable judgement, taken as an answer attempt'
  ELSE 'refusal code found in an unreadable judgement' END AS llm_evaluation_explanation FROM judge_responses""")
def _(d: Data):
    return R.parse_judgement(d.fixture("judge_responses")).select("model_id", "sample_id", "model_predicted_type", "judge_quality_score", "llm_evaluation_explanation")


CLS = f"CASE WHEN response LIKE 'CLASSIFICATION:%' THEN {field('CLASSIFICATION')} ELSE 'answer_attempt' END"


def score_sql(label: str) -> str:
    return (f"CASE WHEN is_answerable THEN CASE WHEN cls <> 'answer_attempt' OR NOT contains(response, '{label}:') THEN 0 WHEN {field(label)} = 'N/A' THEN NULL "
            f"ELSE coalesce(TRY_CAST({field(label)} AS INT), 0) END END")


@query("parse_comprehensive_judgement", f"""WITH c AS (SELECT *, {CLS} AS cls FROM judge_responses)
SELECT model_id, sample_id, cls AS refusal_classification, {score_sql('ELIGIBILITY')} AS eligibility, {score_sql('FACTUALITY_ALL')} AS factuality_all,
  {score_sql('FACTUALITY_RELEVANT')} AS factuality_relevant, CASE WHEN NOT is_answerable THEN CAST(cls <> 'answer_attempt' AND cls = ground_truth_label AS INT) END AS refusal_appropriateness,
  CASE WHEN contains(response, 'EXPLANATION:') THEN {field('EXPLANATION')} ELSE 'No explanation provided' END AS judge_explanation FROM c""")
def _(d: Data):
    rows = d.fixture("judge_responses").withColumnRenamed("ground_truth_label", "expected_behavior")
    return R.parse_comprehensive(rows).select(
        "model_id", "sample_id", "refusal_classification", "eligibility", "factuality_all", "factuality_relevant", "refusal_appropriateness", "judge_explanation"
    )


def judged(d: Data):
    failed = F.col("model_predicted_type") == "ERROR"
    return d.results().withColumns({
        "judge_quality_score": (F.col("k") % 5 + 1).cast("double"), "error": F.when(failed, "boom"), "llm_evaluation_explanation": F.lit("fine"),
        "eligibility": (F.col("k") % 2).cast("int"), "factuality_all": F.lit(1), "factuality_relevant": (F.col("k") % 3 % 2).cast("int"),
        "refusal_appropriateness": (F.col("model_predicted_type") == F.col("ground_truth_label")).cast("int"),
    })


GT, PT = "ground_truth_label", "model_predicted_type"


@query("dual_outcome", f"""SELECT k, model_id, {PT} AS model_predicted_type, CASE WHEN {PT} = 'answer_attempt' AND is_answerable THEN CAST(k % 5 + 1 AS DOUBLE) END AS answer_quality_score,
  CASE WHEN {PT} = 'ERROR' OR (is_answerable AND {PT} = 'answer_attempt') THEN NULL ELSE {PT} = {GT} END AS refusal_match_correct,
  CASE WHEN {PT} = 'ERROR' THEN 'evaluation failed' WHEN is_answerable AND {PT} = 'answer_attempt' THEN 'fine' WHEN is_answerable THEN 'false refusal: ' || {PT}
    WHEN {PT} = 'answer_attempt' THEN 'missed refusal: expected ' || {GT} WHEN {PT} = {GT} THEN 'exact match: ' || {PT} ELSE 'mismatch: predicted ' || {PT} || ', expected ' || {GT} END AS llm_evaluation_explanation
FROM eval_results""")
def _(d: Data):
    return R.dual_outcome(judged(d)).select("k", "model_id", "model_predicted_type", "answer_quality_score", "refusal_match_correct", "llm_evaluation_explanation")


@query("dual_outcome_multi", f"""SELECT k, model_id, {PT} AS refusal_classification, CASE WHEN is_answerable THEN CASE WHEN {PT} = 'answer_attempt' THEN CAST(k % 2 AS INT) ELSE 0 END END AS eligibility_score,
  CASE WHEN is_answerable THEN CASE WHEN {PT} = 'answer_attempt' THEN CAST(k % 3 % 2 AS INT) ELSE 0 END END AS raf_score,
  CASE WHEN NOT is_answerable THEN {PT} = {GT} END AS refusal_match_correct, CASE WHEN is_answerable AND {PT} <> 'ERROR' THEN {PT} <> 'answer_attempt' END AS false_refusal,
  CASE WHEN NOT is_answerable AND {PT} <> 'ERROR' THEN {PT} = 'answer_attempt' END AS missed_refusal FROM eval_results""")
def _(d: Data):
    rows = judged(d).withColumnRenamed("model_predicted_type", "refusal_classification")
    return R.dual_outcome(rows, "multi").select("k", "model_id", "refusal_classification", "eligibility_score", "raf_score", "refusal_match_correct", "false_refusal", "missed_refusal")


@query("error_outcome", f"SELECT k, model_id, {PT} AS model_predicted_type, CAST(NULL AS DOUBLE) AS answer_quality_score, CAST(NULL AS BOOLEAN) AS refusal_match_correct FROM eval_results WHERE {PT} = 'ERROR'")
def _(d: Data):
    out = R.dual_outcome(judged(d)).filter("model_predicted_type = 'ERROR'")
    return out.select("k", "model_id", "model_predicted_type", "answer_quality_score", "refusal_match_correct")


# --- work lists -------------------------------------------------------------------------------

CELLS = """cells AS (SELECT c AS perturbation_class, i AS intensity FROM (VALUES ('P-Ambiguity'), ('P-Contradiction'), ('P-MissingInfo'), ('P-FalsePremise'), ('P-GranularityMismatch'), ('P-EpistemicMismatch')) a(c),
  (VALUES ('LOW'), ('MEDIUM'), ('HIGH')) b(i))"""


@query("perturbation_grid", f"WITH {BASE}, {CELLS} SELECT line_no, qid, perturbation_class, intensity FROM bi, cells")
def _(d: Data):
    return J.perturbation_grid(instances(d)).select("line_no", "qid", "perturbation_class", "intensity")


def samples(d: Data):
    return d.table("orders").select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("sample_id"), F.col("o_orderstatus").alias("query"))


ASK = "(VALUES ('model_0'), ('model_1'), ('model_2'), ('model_3'), ('model_4'), ('model_9')) t(model_id)"


@query("evaluation_grid", f"SELECT 's' || o_orderkey AS sample_id, model_id FROM orders, {ASK}")
def _(d: Data):
    return J.evaluation_grid(samples(d), (*MODELS, "model_9")).select("sample_id", "model_id")


@query("resume_pairs", f"""SELECT 's' || o_orderkey AS sample_id, model_id, o_orderstatus AS query FROM orders, {ASK}
WHERE ('s' || o_orderkey, model_id) NOT IN (SELECT (sample_id, model_id) FROM eval_results WHERE model_predicted_type <> 'REFUSE_OTHER')""")
def _(d: Data):
    done = d.results().filter("model_predicted_type <> 'REFUSE_OTHER'")
    return J.remaining(samples(d), done, (*MODELS, "model_9")).select("sample_id", "model_id", "query")


@query("resume_verifications", """SELECT generator_model, line_no, original_query FROM verifications v
WHERE NOT EXISTS (SELECT 1 FROM verifications d WHERE d.line_no % 3 = 0 AND d.generator_model = v.generator_model AND d.perturbed_query = v.perturbed_query)""")
def _(d: Data):
    log = d.votes()
    return J.remaining_verifications(log, log.filter("line_no % 3 = 0")).select("generator_model", "line_no", "original_query")


DONE = f"""ins AS (SELECT DISTINCT CAST(floor(p_partkey / 18) AS BIGINT) AS line_no FROM part), {CELLS},
dn AS (SELECT source_qid, perturbation_class, intensity FROM verifications WHERE verifier_model = 'claude' AND generator_model = 'gpt' AND line_no % 29 <> 0),
mc AS (SELECT line_no, 'q' || line_no AS qid, perturbation_class, intensity FROM ins, cells WHERE ('q' || line_no, perturbation_class, intensity) NOT IN (SELECT (source_qid, perturbation_class, intensity) FROM dn)),
cp AS (SELECT count(*) AS n FROM (SELECT source_qid FROM dn GROUP BY source_qid HAVING count(*) = 18 AND count(DISTINCT perturbation_class || intensity) = 18))"""


def log_of_cells(d: Data):
    ins = d.table("part").select(F.floor(F.col("p_partkey") / 18).cast("long").alias("line_no")).distinct().withColumn("qid", F.concat(F.lit("q"), F.col("line_no").cast("string")))
    done = d.votes().filter("verifier_model = 'claude' AND generator_model = 'gpt'").withColumn("generation_successful", F.col("line_no") % 29 != 0)
    return ins, done


PAIRS = [f"{g}|{v}" for g in ("claude", "deepseek", "gpt", "nova") for v in ("claude", "nova", "gpt", "deepseek")]
#: every generator's and verifier's log, the pair being part of the question's id
DONE_ALL = f"""pairs AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {i})" for i, p in enumerate(PAIRS))}) t(pair, i)),
ins AS (SELECT DISTINCT 16 * CAST(floor(p_partkey / 18) AS BIGINT) + i AS line_no, pair || '|q' || CAST(floor(p_partkey / 18) AS BIGINT) AS qid FROM part, pairs), {CELLS},
dn AS (SELECT generator_model || '|' || verifier_model || '|' || source_qid AS source_qid, perturbation_class, intensity FROM verifications WHERE line_no % 29 <> 0),
mc AS (SELECT line_no, qid, perturbation_class, intensity FROM ins, cells WHERE (qid, perturbation_class, intensity) NOT IN (SELECT (source_qid, perturbation_class, intensity) FROM dn)),
cp AS (SELECT count(*) AS n FROM (SELECT source_qid FROM dn GROUP BY source_qid HAVING count(*) = 18 AND count(DISTINCT perturbation_class || intensity) = 18))"""


def log_of_all_cells(d: Data):
    pairs = F.posexplode(F.array(*[F.lit(p) for p in PAIRS])).alias("i", "pair")
    line = F.floor(F.col("p_partkey") / 18).cast("long")
    ins = d.table("part").select(line.alias("line")).distinct().select("line", pairs).select(
        (16 * F.col("line") + F.col("i")).alias("line_no"), F.concat("pair", F.lit("|q"), F.col("line").cast("string")).alias("qid")
    )
    done = d.votes().withColumns({
        "source_qid": F.concat_ws("|", "generator_model", "verifier_model", "source_qid"), "generation_successful": F.col("line_no") % 29 != 0,
    })
    return ins, done


@query("missing_cells", f"WITH {DONE_ALL} SELECT qid, perturbation_class, intensity FROM mc")
def _(d: Data):
    return J.missing_cells(*log_of_all_cells(d)).select("qid", "perturbation_class", "intensity")


@query("missing_cells_target", f"""WITH {DONE_ALL}, op AS (SELECT line_no, row_number() OVER (ORDER BY line_no) AS r FROM (SELECT DISTINCT line_no FROM mc))
SELECT qid, perturbation_class, intensity FROM mc JOIN op USING (line_no) WHERE r <= 900 - (SELECT n FROM cp)""")
def _(d: Data):
    return J.missing_cells(*log_of_all_cells(d), target=900).select("qid", "perturbation_class", "intensity")


# --- results kept across runs --------------------------------------------------------------------


@query("dedupe_last", "SELECT sample_id, model_id, CASE WHEN k % 4 = 0 THEN 'REDO' ELSE model_predicted_type END AS model_predicted_type FROM eval_results")
def _(d: Data):
    r = d.results().select("sample_id", "model_id", "model_predicted_type", F.col("k").alias("seq"))
    again = r.filter("seq % 4 = 0").withColumns({"model_predicted_type": F.lit("REDO"), "seq": F.col("seq") + 1000000000})
    return S.dedupe_last(r.unionByName(again), ["sample_id", "model_id"], "seq").drop("seq")


@query("merge_results", "SELECT sample_id, model_id, CASE WHEN k % 3 = 0 THEN 'NEW' ELSE model_predicted_type END AS model_predicted_type FROM eval_results WHERE k % 3 = 0 OR k % 2 = 0")
def _(d: Data):
    r = d.results()
    cols = ("sample_id", "model_id", "model_predicted_type")
    old = r.filter("k % 2 = 0").select(*cols)
    return S.merge_results(old, r.filter("k % 3 = 0").withColumn("model_predicted_type", F.lit("NEW")).select(*cols))
