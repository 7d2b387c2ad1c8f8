"""Checked queries over the evaluation results (fixture eval_results)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Data, query, rounded
from demur.operators import metrics as M
from demur.operators import multidoc as MD

MODELS = ("model_0", "model_1", "model_2", "model_3", "model_4")
ASKED = MODELS + ("model_9",)
SIZES = {"model_0": 7, "model_2": 56, "model_4": 70, "model_8": 8}
PAIRS = [("model_0", "model_1"), ("model_2", "model_3"), ("model_4", "model_8")]

A = "ground_truth_label = 'ANSWER_CORRECTLY'"
U = "ground_truth_label <> 'ANSWER_CORRECTLY'"
ATT = "model_predicted_type = 'answer_attempt'"
REF = "model_predicted_type <> 'answer_attempt'"
OK = f"(CASE WHEN {A} THEN {ATT} AND answer_quality_score >= 4 ELSE refusal_match_correct END)"
MATCH = "CAST(refusal_match_correct AS INT)"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE CAST({a} AS DOUBLE) / {b} END)"


BOARD = f"""
WITH c AS (SELECT model_id, count(*) AS n, count(*) FILTER (WHERE {A}) AS na, count(*) FILTER (WHERE {U}) AS nu,
    count(*) FILTER (WHERE {A} AND {ATT} AND answer_quality_score >= 4) AS good,
    avg({MATCH}) FILTER (WHERE {U}) AS match,
    count(*) FILTER (WHERE {A} AND {REF}) AS fr, count(*) FILTER (WHERE {U} AND {ATT}) AS mr,
    count(*) FILTER (WHERE {U} AND {REF}) AS tr, count(*) FILTER (WHERE {U} AND {REF} AND refusal_match_correct) AS cr
  FROM eval_results @where@ GROUP BY model_id),
d AS (SELECT *, {div('good', 'na')} AS answer_accuracy, CASE WHEN nu = 0 THEN 0 ELSE match END AS refusal_accuracy,
    {div('tr', '(tr + fr)')} AS prec, {div('tr', 'nu')} AS rec, {div('cr', 'tr')} AS category_accuracy FROM c),
e AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * (prec * rec) / (prec + rec) END AS f1 FROM d),
board AS (SELECT model_id, answer_accuracy, refusal_accuracy, 0.5::DOUBLE * answer_accuracy + 0.5::DOUBLE * refusal_accuracy AS calibrated_refusal_score,
  {div('fr', 'na')} AS false_refusal_rate, {div('mr', 'nu')} AS missed_refusal_rate, rec AS overall_refusal_rate,
  prec AS refusal_precision, rec AS refusal_recall, f1 AS refusal_detection_f1, category_accuracy,
  f1 * category_accuracy AS hierarchical_refusal_score, n AS total_instances, na AS answerable_instances, nu AS unanswerable_instances
  FROM e)
"""


def board_sql(rest: str = "SELECT * FROM board", where: str = "") -> str:
    return BOARD.replace("@where@", where) + rest


@query("leaderboard", board_sql())
def _(d: Data):
    return M.ranked_leaderboard(d.results())


@query("evaluator_metrics", f"""
WITH c AS (SELECT model_id, count(*) FILTER (WHERE {A}) AS na, count(*) FILTER (WHERE {U}) AS nu,
    count(*) FILTER (WHERE {A} AND {ATT} AND answer_quality_score >= 4) AS good,
    count(*) FILTER (WHERE {A} AND model_predicted_type LIKE 'REFUSE%') AS fr,
    count(*) FILTER (WHERE {U} AND refusal_match_correct) AS ok,
    count(*) FILTER (WHERE {U} AND model_predicted_type LIKE 'REFUSE%') AS tr,
    count(*) FILTER (WHERE {U} AND {ATT}) AS mr
  FROM eval_results GROUP BY model_id)
SELECT model_id, {div('good', 'na')} AS accuracy, {div('fr', 'na')} AS false_refusal_rate, {div('ok', 'nu')} AS refusal_accuracy,
  {div('tr', 'nu')} AS overall_refusal_rate, {div('mr', 'nu')} AS missed_refusal_rate,
  0.5::DOUBLE * {div('good', 'na')} + 0.5::DOUBLE * {div('ok', 'nu')} AS calibrated_refusal_score,
  na AS num_answerable, nu AS num_unanswerable FROM c""")
def _(d: Data):
    return M.evaluator_metrics(d.results())


@query("frontier_leaderboard", board_sql(where="WHERE model_id IN ('model_1', 'model_3', 'model_9')"))
def _(d: Data):
    return M.frontier_leaderboard(d.results(), ["model_1", "model_3", "model_9"])


CONFUSION = f"""SELECT model_id, ground_truth_label, model_predicted_type, count(*) AS n
FROM eval_results WHERE {U} GROUP BY ALL"""


@query("confusion_matrix", CONFUSION)
def _(d: Data):
    return M.confusion_matrix(d.results())


@query("confusion_matrix_by_intensity", f"""SELECT model_id, intensity, ground_truth_label, model_predicted_type, count(*) AS n
FROM eval_results WHERE {U} GROUP BY ALL""")
def _(d: Data):
    return M.confusion_matrix(d.results(), by_intensity=True)


@query("confusion_matrix_mean", f"""SELECT ground_truth_label, model_predicted_type,
  CAST(count(*) AS DOUBLE) / (SELECT count(DISTINCT model_id) FROM eval_results WHERE {U}) AS mean_n
FROM eval_results WHERE {U} GROUP BY ALL""")
def _(d: Data):
    return M.mean_confusion(M.confusion_matrix(d.results()))


@query("cohen_kappa", f"""
WITH u AS (SELECT model_id, ground_truth_label AS g, model_predicted_type AS p FROM eval_results WHERE {U}),
o AS (SELECT model_id, count(*) AS n, avg(CAST(g = p AS INT)) AS po FROM u GROUP BY model_id),
gm AS (SELECT model_id, g AS l, count(*) AS x FROM u GROUP BY ALL), pm AS (SELECT model_id, p AS l, count(*) AS y FROM u GROUP BY ALL),
e AS (SELECT model_id, CAST(sum(x * y) AS DOUBLE) AS cr FROM gm JOIN pm USING (model_id, l) GROUP BY model_id),
k AS (SELECT model_id, po, cr / (CAST(n AS DOUBLE) * n) AS pe FROM o JOIN e USING (model_id))
SELECT model_id, po AS observed_agreement, pe AS expected_agreement,
  CASE WHEN 1 - pe = 0 THEN 0 ELSE (po - pe) / (1 - pe) END AS cohen_kappa FROM k""")
def _(d: Data):
    return M.cohen_kappa(d.results())


MID = """(CASE confidence_level WHEN 'VERY_UNCERTAIN' THEN (0.0::DOUBLE + 0.3::DOUBLE) / 2 WHEN 'UNCERTAIN' THEN (0.3::DOUBLE + 0.5::DOUBLE) / 2
  WHEN 'SOMEWHAT_CONFIDENT' THEN (0.5::DOUBLE + 0.7::DOUBLE) / 2 WHEN 'CONFIDENT' THEN (0.7::DOUBLE + 0.9::DOUBLE) / 2
  WHEN 'VERY_CONFIDENT' THEN (0.9::DOUBLE + 1.0::DOUBLE) / 2 END)"""
LEVELS = f"""WITH lv AS (SELECT model_id, confidence_level, {MID} AS mid, count(*) AS n, count(*) FILTER (WHERE {OK}) AS ok,
  count(*) FILTER (WHERE {A}) AS na, count(*) FILTER (WHERE {A} AND {OK}) AS oka,
  count(*) FILTER (WHERE {U}) AS nu, count(*) FILTER (WHERE {U} AND {OK}) AS oku FROM eval_results GROUP BY ALL)"""


@query("calibration_error", LEVELS + """
SELECT model_id, round(sum(n * abs(CAST(ok AS DOUBLE) / n - mid)) / sum(n), 9) AS expected_calibration_error,
  CAST(sum(ok) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS overall_accuracy, CAST(sum(n) AS BIGINT) AS total_samples FROM lv GROUP BY model_id""")
def _(d: Data):
    return rounded(M.calibration_error(d.results()), "expected_calibration_error")


@query("calibration_decomposed", LEVELS + f"""
SELECT model_id, round(sum(n * abs(CAST(ok AS DOUBLE) / n - mid)) / sum(n), 9) AS ece_overall,
  round(sum(na * abs({div('oka', 'na')} - mid)) / sum(na), 9) AS ece_answer,
  round(sum(nu * abs({div('oku', 'nu')} - mid)) / sum(nu), 9) AS ece_refusal FROM lv GROUP BY model_id""")
def _(d: Data):
    return rounded(M.calibration_decomposed(d.results()), "ece_overall", "ece_answer", "ece_refusal")


@query("reliability_bins", LEVELS + """
SELECT model_id, confidence_level, CAST(ok AS DOUBLE) / n AS accuracy, mid AS confidence, n AS count, abs(CAST(ok AS DOUBLE) / n - mid) AS gap FROM lv""")
def _(d: Data):
    return M.reliability_bins(d.results())


BY_CLASS = f"""SELECT model_id, substring(ground_truth_label, 8) AS perturbation_type, avg({MATCH}) AS refusal_accuracy,
  avg(CAST({REF} AS INT)) AS refusal_rate, count(*) AS instances FROM eval_results WHERE {U} GROUP BY ALL"""
BY_INTENSITY = f"""SELECT model_id, intensity, avg({MATCH}) AS refusal_accuracy,
  avg(CAST({REF} AS INT)) AS refusal_rate, count(*) AS instances FROM eval_results WHERE {U} GROUP BY ALL"""


@query("refusal_by_class", BY_CLASS)
def _(d: Data):
    return M.refusal_by_class(d.results())


@query("model_class_distribution", f"""SELECT model_id, substring(ground_truth_label, 8) AS perturbation_type,
  avg(CAST({REF} AS INT)) AS refusal_rate, avg({MATCH}) AS accuracy, count(*) AS instances FROM eval_results WHERE {U} GROUP BY ALL""")
def _(d: Data):
    return M.model_class_distribution(d.results())


@query("refusal_by_intensity", BY_INTENSITY)
def _(d: Data):
    return M.refusal_by_intensity(d.results())


@query("coverage_matrix", """
WITH cells AS (SELECT c, i FROM (SELECT DISTINCT substring(ground_truth_label, 8) AS c FROM eval_results WHERE ground_truth_label <> 'ANSWER_CORRECTLY'),
  (SELECT DISTINCT intensity AS i FROM eval_results))
SELECT c AS class_name, i AS intensity, count(k) AS n FROM cells LEFT JOIN eval_results
  ON contains(ground_truth_label, 'REFUSE_' || c) AND intensity = i GROUP BY ALL""")
def _(d: Data):
    return M.coverage_matrix(d.results())


@query("coverage_matrix_by_class", "SELECT perturbation_class AS class_name, intensity, count(*) AS n FROM eval_results GROUP BY ALL")
def _(d: Data):
    return M.coverage_matrix(d.results(), by="class")


COMPARED = "answer_accuracy, refusal_accuracy, calibrated_refusal_score"


@query("scaling_table", board_sql(f"""SELECT model_id, CAST(size_b AS INT) AS size_b, {COMPARED} FROM board
JOIN (VALUES ('model_0', 7), ('model_2', 56), ('model_4', 70), ('model_8', 8)) t(model_id, size_b) USING (model_id)"""))
def _(d: Data):
    return M.scaling_table(M.leaderboard(d.results()), SIZES)


@query("metric_pairs", board_sql("""SELECT CAST(pair AS INT) AS pair, a AS base_model, b AS other_model,
  x.answer_accuracy AS base_answer_accuracy, x.refusal_accuracy AS base_refusal_accuracy, x.calibrated_refusal_score AS base_calibrated_refusal_score,
  y.answer_accuracy AS other_answer_accuracy, y.refusal_accuracy AS other_refusal_accuracy, y.calibrated_refusal_score AS other_calibrated_refusal_score
FROM (VALUES (0, 'model_0', 'model_1'), (1, 'model_2', 'model_3'), (2, 'model_4', 'model_8')) t(pair, a, b)
JOIN board x ON x.model_id = a JOIN board y ON y.model_id = b"""))
def _(d: Data):
    return M.metric_pairs(M.leaderboard(d.results()), PAIRS)


@query("budget_deltas", board_sql("""SELECT x.model_id AS base_model, y.model_id AS other_model,
  (y.answer_accuracy - x.answer_accuracy) * 100::DOUBLE AS answer_accuracy_change,
  (y.refusal_accuracy - x.refusal_accuracy) * 100::DOUBLE AS refusal_accuracy_change,
  (y.calibrated_refusal_score - x.calibrated_refusal_score) * 100::DOUBLE AS calibrated_refusal_score_change
FROM board x JOIN board y ON x.model_id = 'model_1' AND y.model_id = 'model_4'"""))
def _(d: Data):
    return M.budget_deltas(M.leaderboard(d.results()), "model_1", "model_4")


@query("alignment_pairs", board_sql(""", g AS (SELECT a AS base_model, b AS other_model,
  y.answer_accuracy - x.answer_accuracy AS answer_accuracy_gain, y.refusal_accuracy - x.refusal_accuracy AS refusal_accuracy_gain,
  y.calibrated_refusal_score - x.calibrated_refusal_score AS calibrated_refusal_score_gain
  FROM (VALUES ('model_0', 'model_1'), ('model_2', 'model_3'), ('model_4', 'model_8')) t(a, b)
  JOIN board x ON x.model_id = a JOIN board y ON y.model_id = b),
h AS (SELECT * FROM g UNION ALL SELECT 'mean', 'mean', avg(answer_accuracy_gain), avg(refusal_accuracy_gain), avg(calibrated_refusal_score_gain) FROM g)
SELECT base_model, other_model, round(answer_accuracy_gain, 9) AS answer_accuracy_gain, round(refusal_accuracy_gain, 9) AS refusal_accuracy_gain,
  round(calibrated_refusal_score_gain, 9) AS calibrated_refusal_score_gain FROM h"""))
def _(d: Data):
    return rounded(
        M.alignment_pairs(M.leaderboard(d.results()), PAIRS),
        "answer_accuracy_gain", "refusal_accuracy_gain", "calibrated_refusal_score_gain",
    )


def _summary(expr: str, name: str) -> str:
    return (f"round(avg({expr}), 9) AS mean_{name}, round(stddev_pop({expr}), 9) AS std_{name}, "
            f"round(min({expr}), 9) AS min_{name}, round(max({expr}), 9) AS max_{name}")


@query("dataset_summary", board_sql(f"""SELECT count(*) AS total_models, {_summary('answer_accuracy', 'answer')}, {_summary('refusal_accuracy', 'refusal')},
  {_summary('calibrated_refusal_score', 'crs')}, round(avg(answer_accuracy - refusal_accuracy), 9) AS mean_gap,
  count(*) FILTER (WHERE answer_accuracy > refusal_accuracy) AS models_answer_above_refusal FROM board"""))
def _(d: Data):
    df = M.dataset_summary(M.leaderboard(d.results()))
    return rounded(df, *[c for c in df.columns if c not in ("total_models", "models_answer_above_refusal")])


@query("dataset_top", board_sql("SELECT model_id, calibrated_refusal_score FROM board ORDER BY calibrated_refusal_score DESC, model_id LIMIT 3"))
def _(d: Data):
    return M.dataset_top(M.leaderboard(d.results()))


@query("top_k", board_sql("SELECT * FROM board ORDER BY refusal_detection_f1 DESC, model_id LIMIT 2"))
def _(d: Data):
    return M.top_k(M.leaderboard(d.results()), "refusal_detection_f1", 2)


@query("model_ranking", board_sql("SELECT model_id, calibrated_refusal_score, CAST(rank() OVER (ORDER BY calibrated_refusal_score DESC) AS INT) AS rank FROM board"))
def _(d: Data):
    return M.model_ranking(M.leaderboard(d.results()))


@query("detailed_results", board_sql(f"""SELECT 'overall' AS level, 'all' AS value, 'single' AS dataset, * FROM board
UNION ALL BY NAME SELECT 'class' AS level, perturbation_type AS value, 'single' AS dataset, model_id, refusal_accuracy, refusal_rate AS overall_refusal_rate,
  instances AS unanswerable_instances FROM ({BY_CLASS})
UNION ALL BY NAME SELECT 'intensity' AS level, intensity AS value, 'single' AS dataset, model_id, refusal_accuracy, refusal_rate AS overall_refusal_rate,
  instances AS unanswerable_instances FROM ({BY_INTENSITY})"""))
def _(d: Data):
    return M.detailed_results(d.results())


@query("run_progress", """
SELECT m AS model_id, count(e.k) AS finished, count(DISTINCT e.sample_id) AS distinct_samples,
  (SELECT count(DISTINCT sample_id) FROM eval_results) - count(DISTINCT e.sample_id) AS remaining,
  (SELECT count(DISTINCT sample_id) FROM eval_results) <> count(DISTINCT e.sample_id) AS size_mismatch
FROM (VALUES ('model_0'), ('model_1'), ('model_9')) t(m) LEFT JOIN
  (SELECT * FROM eval_results WHERE model_id <> 'model_1' OR (k * 7) % 10 < 6) e ON e.model_id = m GROUP BY m""")
def _(d: Data):
    done = d.results().filter("model_id <> 'model_1' OR (k * 7) % 10 < 6")
    return M.run_progress(done, d.results(), ["model_0", "model_1", "model_9"])


@query("missing_models", "SELECT m AS model_id FROM (VALUES ('model_0'), ('model_3'), ('model_9')) t(m) WHERE m NOT IN (SELECT model_id FROM eval_results)")
def _(d: Data):
    return M.missing_models(d.results(), ["model_0", "model_3", "model_9"])


# --- multi-document ------------------------------------------------------------------


def multi(d: Data):
    """eval_results in the multi-document schema; flags follow from the label."""
    ref = F.col("refusal_classification")
    error = ref == "ERROR"
    return (
        MD.as_multidoc(d.results())
        .withColumns({
            "unadjusted_factuality_score": F.when(F.col("is_answerable"), F.greatest("raf_score", "eligibility_score")),
            "false_refusal": F.when(F.col("is_answerable") & ~error, ref != "answer_attempt"),
            "missed_refusal": F.when(~F.col("is_answerable") & ~error, ref == "answer_attempt"),
            "question_complexity": F.when(F.length("question_category") % 2 == 0, "Simple").otherwise("Set"),
        })
    )


MULTI = """multi AS (SELECT *, ground_truth_label AS expected_behavior, model_predicted_type AS refusal_classification,
  CASE WHEN is_answerable THEN greatest(raf_score, eligibility_score) END AS unadjusted_factuality_score,
  CASE WHEN is_answerable AND model_predicted_type <> 'ERROR' THEN model_predicted_type <> 'answer_attempt' END AS false_refusal,
  CASE WHEN NOT is_answerable AND model_predicted_type <> 'ERROR' THEN model_predicted_type = 'answer_attempt' END AS missed_refusal,
  CASE WHEN length(question_category) % 2 = 0 THEN 'Simple' ELSE 'Set' END AS question_complexity FROM eval_results)"""
NA, NU = "count(*) FILTER (WHERE is_answerable)", "count(*) FILTER (WHERE NOT is_answerable)"


def z(mean: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0 ELSE {mean} END"


MULTI_METRICS = f"""mm AS (SELECT model_id, {z('avg(eligibility_score) FILTER (WHERE is_answerable)', NA)} AS eligibility,
  {z('avg(unadjusted_factuality_score) FILTER (WHERE is_answerable)', NA)} AS unadjusted_factuality,
  {z('avg(raf_score) FILTER (WHERE is_answerable)', NA)} AS raf,
  {z('avg(CAST(false_refusal AS INT)) FILTER (WHERE is_answerable)', NA)} AS false_refusal_rate,
  {z(f'avg({MATCH}) FILTER (WHERE NOT is_answerable)', NU)} AS refusal_accuracy,
  {z('avg(CAST(missed_refusal AS INT)) FILTER (WHERE NOT is_answerable)', NU)} AS missed_refusal_rate,
  {div("count(*) FILTER (WHERE NOT is_answerable AND refusal_classification <> 'answer_attempt')", NU)} AS overall_refusal_rate,
  {NA} AS num_answerable, {NU} AS num_unanswerable FROM multi GROUP BY model_id)"""


@query("multidoc_metrics", f"WITH {MULTI}, {MULTI_METRICS} SELECT * FROM mm")
def _(d: Data):
    return MD.multidoc_metrics(multi(d))


@query("hybrid_score", f"""WITH {MULTI}, {MULTI_METRICS} SELECT *, CASE
  WHEN num_answerable > 0 AND num_unanswerable > 0 THEN CAST(num_answerable AS DOUBLE) / (num_answerable + num_unanswerable) * raf
    + CAST(num_unanswerable AS DOUBLE) / (num_answerable + num_unanswerable) * refusal_accuracy
  WHEN num_answerable > 0 THEN raf WHEN num_unanswerable > 0 THEN refusal_accuracy ELSE 0 END AS hybrid_score FROM mm""")
def _(d: Data):
    return MD.hybrid_score(MD.multidoc_metrics(multi(d)))


def _breakdown(dim: str) -> str:
    elig = "avg(eligibility_score) FILTER (WHERE is_answerable)" if dim == "question_category" else "CAST(NULL AS DOUBLE)"
    return f"""SELECT model_id, '{dim}' AS dimension, {dim} AS value, count(*) AS total_count, {NA} AS answerable_count, {NU} AS unanswerable_count,
  avg(raf_score) FILTER (WHERE is_answerable) AS raf, {elig} AS eligibility, avg({MATCH}) FILTER (WHERE NOT is_answerable) AS refusal_accuracy
  FROM multi GROUP BY model_id, {dim}"""


BREAKDOWNS = "bd AS (" + " UNION ALL ".join(_breakdown(x) for x in MD.DIMENSIONS) + ")"


@query("breakdowns", f"WITH {MULTI}, {BREAKDOWNS} SELECT * FROM bd")
def _(d: Data):
    return MD.breakdowns(multi(d))


@query("top_domains", f"""WITH {MULTI}, {BREAKDOWNS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY model_id, dimension
  ORDER BY total_count DESC, value) AS INT) AS position FROM bd WHERE dimension IN ('question_category', 'perturbation_class'))
SELECT model_id, dimension, position, value, total_count, raf, refusal_accuracy FROM r WHERE position <= 3""")
def _(d: Data):
    return MD.top_domains(MD.breakdowns(multi(d)))


MRES = "refusal_classification <> 'answer_attempt'"
MATT = "refusal_classification = 'answer_attempt'"
FRONTIER = f"""fr0 AS (SELECT model_id, count(*) AS total_instances, {NA} AS answerable_instances, {NU} AS unanswerable_instances,
  count(*) FILTER (WHERE is_answerable AND {MATT}) AS aa, count(*) FILTER (WHERE is_answerable AND {MRES}) AS ar,
  count(*) FILTER (WHERE NOT is_answerable AND {MATT}) AS ua, count(*) FILTER (WHERE NOT is_answerable AND {MRES}) AS ur,
  avg(raf_score) FILTER (WHERE is_answerable AND {MATT}) AS raf, avg({MATCH}) FILTER (WHERE NOT is_answerable) AS mt,
  avg({MATCH}) FILTER (WHERE NOT is_answerable AND {MRES}) AS ct FROM multi GROUP BY model_id),
fr1 AS (SELECT *, {z('raf', 'aa')} AS q, {z('mt', 'unanswerable_instances')} AS ra, {div('ur', '(ur + ar)')} AS p, {div('ur', 'unanswerable_instances')} AS r,
  {z('ct', 'ur')} AS cat FROM fr0),
fr2 AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * (p * r) / (p + r) END AS f1 FROM fr1),
mb AS (SELECT model_id, q AS answer_quality_score, ra AS refusal_accuracy, 0.5::DOUBLE * q + 0.5::DOUBLE * ra AS calibrated_refusal_score,
  {div('ar', 'answerable_instances')} AS false_refusal_rate, {div('ua', 'unanswerable_instances')} AS missed_refusal_rate,
  p AS refusal_precision, r AS refusal_recall, f1 AS refusal_detection_f1, cat AS category_accuracy, f1 * cat AS hierarchical_refusal_score,
  {div('(ar + ur)', 'total_instances')} AS refusal_volume, total_instances, answerable_instances, unanswerable_instances FROM fr2)"""


@query("multidoc_frontier", f"WITH {MULTI}, {FRONTIER} SELECT * FROM mb WHERE model_id IN ('model_0', 'model_1', 'model_4')")
def _(d: Data):
    return MD.multidoc_frontier(multi(d), ["model_0", "model_1", "model_4", "model_9"])


@query("cross_dataset_union", board_sql(f""", {MULTI}, {FRONTIER}
SELECT 'single' AS dataset, * FROM board UNION ALL BY NAME SELECT 'multi' AS dataset, * FROM mb"""))
def _(d: Data):
    return M.summary_table(M.leaderboard(d.results()), MD.multidoc_frontier(multi(d)))


@query("cross_dataset_gap", board_sql(f""", {MULTI}, {FRONTIER}, x AS (SELECT (SELECT avg(calibrated_refusal_score) FROM board) AS a,
  (SELECT avg(calibrated_refusal_score) FROM mb) AS b) SELECT round(a, 9) AS mean_a, round(b, 9) AS mean_b, round(a - b, 9) AS difference FROM x"""))
def _(d: Data):
    return rounded(
        M.cross_dataset_gap(M.leaderboard(d.results()), MD.multidoc_frontier(multi(d))), "mean_a", "mean_b", "difference"
    )


def share(cond: str) -> str:
    return f"{div(f'count(*) FILTER (WHERE {cond})', 'count(*)')} * 100::DOUBLE"


@query("response_distribution", f"""WITH {MULTI} SELECT model_id, {share('is_answerable AND raf_score >= 0.8')} AS high_quality_answers,
  {share('is_answerable AND raf_score < 0.8')} AS low_quality_answers, {share(f'NOT is_answerable AND {MRES} AND refusal_match_correct')} AS correct_refusals,
  {share(f'NOT is_answerable AND {MRES} AND NOT refusal_match_correct')} AS wrong_refusals, {share(f'is_answerable AND {MRES}')} AS false_refusals,
  {share(f'NOT is_answerable AND {MATT}')} AS missed_refusals FROM multi GROUP BY model_id""")
def _(d: Data):
    return MD.response_distribution(multi(d))


@query("answer_quality", f"""WITH {MULTI}, q AS (SELECT model_id, coalesce(avg(raf_score) FILTER (WHERE is_answerable), 0) AS a,
  coalesce(avg(CAST(raf_score >= 0.8 AS INT)) FILTER (WHERE is_answerable), 0) AS h, {z(f'avg({MATCH}) FILTER (WHERE NOT is_answerable)', NU)} AS r FROM multi GROUP BY model_id)
SELECT model_id, a AS answer_quality_score, h AS high_quality_answer_rate, r AS refusal_accuracy, 0.5::DOUBLE * a + 0.5::DOUBLE * r AS calibrated_refusal_score FROM q""")
def _(d: Data):
    return MD.answer_quality(multi(d))


@query("domain_performance", f"""WITH {MULTI} SELECT coalesce(model_id, 'all') AS model_id, question_category AS domain,
  {z(f'avg(raf_score) FILTER (WHERE is_answerable AND {MATT})', f'count(*) FILTER (WHERE is_answerable AND {MATT})')} AS raf_score,
  {z(f'avg({MATCH}) FILTER (WHERE NOT is_answerable)', NU)} AS refusal_accuracy, count(*) AS total_instances,
  {NA} AS answerable_instances, {NU} AS unanswerable_instances
FROM multi GROUP BY GROUPING SETS ((question_category), (model_id, question_category))""")
def _(d: Data):
    return MD.domain_performance(multi(d))
