"""Checked queries over the verification log (fixture verifications)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Data, query, rounded
from demur.functions import keys as K
from demur.operators import analysis as A
from demur.operators import sampling as S
from demur.operators import unified as UN
from demur.operators import voting as V
from demur.plans.shared import materialise

def exact(*columns: str) -> str:
    """Every part after its length, as the engine's keys have it."""
    return "concat(" + ", ".join(f"length({c}), ':', {c}" for c in columns) + ")"


_CONTENT = ("source_qid", "perturbed_query", "perturbed_context", "perturbation_class", "intensity", "lever_selected")
CONTENT = exact(*_CONTENT)
READABLE = f"concat_ws('|', {', '.join(_CONTENT)})"
LAST = f"""last AS (SELECT * FROM (SELECT *, md5({CONTENT}) AS content_key, row_number() OVER (PARTITION BY generator_model, verifier_model, {CONTENT}
  ORDER BY line_no DESC) AS rn FROM verifications) WHERE rn = 1),
tagged AS (SELECT *, CASE WHEN verification_successful THEN verification_result ELSE 'ERROR' END AS result FROM last)"""
G = "generator_model, content_key, source_qid, perturbation_class, intensity, lever_selected"
ALIGNED = LAST + f""", aligned AS (SELECT {G}, CAST(count(*) AS INT) AS responding, CAST(count(*) FILTER (WHERE verification_successful) AS INT) AS successful,
  CAST(count(*) FILTER (WHERE result = 'PASS') AS INT) AS pass_votes, CAST(count(*) FILTER (WHERE result = 'FAIL') AS INT) AS fail_votes,
  coalesce(max(result) FILTER (WHERE verifier_model = 'claude'), 'MISSING') AS result_claude, coalesce(max(result) FILTER (WHERE verifier_model = 'nova'), 'MISSING') AS result_nova,
  coalesce(max(result) FILTER (WHERE verifier_model = 'gpt'), 'MISSING') AS result_gpt, coalesce(max(result) FILTER (WHERE verifier_model = 'deepseek'), 'MISSING') AS result_deepseek,
  count(*) = 4 AS is_complete, count(*) FILTER (WHERE result = 'PASS') = 4 AS una,
  count(*) FILTER (WHERE result = 'PASS') > count(*) FILTER (WHERE verification_successful) / 2 AS maj
  FROM tagged GROUP BY ALL), full_groups AS (SELECT * FROM aligned WHERE is_complete)"""
W = f"WITH {ALIGNED} "
KEPT = "kept AS (SELECT * FROM full_groups WHERE una)"
PCT = "CASE WHEN {1} = 0 THEN 0.0::DOUBLE ELSE CAST({0} AS DOUBLE) / {1} * 100::DOUBLE END"


def pct(a: str, b: str) -> str:
    return PCT.format(a, b)


def aligned(d: Data):
    return V.align(d.votes())


def full(d: Data):
    return V.complete(aligned(d))


def kept(d: Data):
    return V.unanimous_filter(aligned(d))


def written(d: Data):
    """``kept`` for operators that read it several times."""
    return materialise(kept(d), "kept")


@query("verifier_alignment", W + f"SELECT {G}, responding, is_complete FROM aligned")
def _(d: Data):
    return aligned(d).select(*V.GROUP, "responding", "is_complete")


@query("vote_tally", W + f"SELECT {G}, responding, successful, pass_votes, fail_votes, result_claude, result_nova, result_gpt, result_deepseek FROM aligned")
def _(d: Data):
    return V.vote_tally(aligned(d))


TALLY = f"{G}, responding, successful, pass_votes, fail_votes"


@query("unanimous_filter", W + f"SELECT {TALLY} FROM full_groups WHERE una")
def _(d: Data):
    return V.unanimous_filter(aligned(d)).select(*V.GROUP, "responding", "successful", "pass_votes", "fail_votes")


@query("majority_filter", W + f"SELECT {TALLY} FROM full_groups WHERE maj")
def _(d: Data):
    return V.majority_filter(aligned(d)).select(*V.GROUP, "responding", "successful", "pass_votes", "fail_votes")


@query("valid_vote_filter", W + f"""SELECT 'all_agree' AS mode, {TALLY} FROM aligned WHERE successful > 0 AND pass_votes = successful
UNION ALL SELECT 'majority_agree' AS mode, {TALLY} FROM aligned WHERE successful > 0 AND pass_votes > successful / 2""")
def _(d: Data):
    cols = (*V.GROUP, "responding", "successful", "pass_votes", "fail_votes")
    return (
        V.valid_vote_filter(aligned(d), "all_agree").select(F.lit("all_agree").alias("mode"), *cols)
        .unionByName(V.valid_vote_filter(aligned(d), "majority_agree").select(F.lit("majority_agree").alias("mode"), *cols))
    )


@query("vote_statistics", W + f""", s AS (SELECT *, nullif(pass_votes + fail_votes, 0) AS n FROM aligned)
SELECT {G}, n AS total_valid_verifications, CASE WHEN n > 0 THEN pass_votes END AS valid_pass_votes, CASE WHEN n > 0 THEN fail_votes END AS valid_fail_votes,
  CAST(pass_votes AS DOUBLE) / n * 100::DOUBLE AS pass_percentage, pass_votes = n AS unanimous_pass, fail_votes = n AS unanimous_fail,
  pass_votes > n / 2 AS majority_pass, fail_votes > n / 2 AS majority_fail FROM s""")
def _(d: Data):
    return V.vote_statistics(aligned(d))


@query("agreement_funnel", W + f"""SELECT generator_model, count(*) AS total_groups, count(*) FILTER (WHERE is_complete) AS complete_groups,
  count(*) FILTER (WHERE is_complete AND una) AS unanimous_groups, count(*) FILTER (WHERE is_complete AND maj) AS majority_groups,
  count(*) FILTER (WHERE is_complete AND maj) AS qualifying_groups, {pct('count(*) FILTER (WHERE is_complete AND maj)', 'count(*) FILTER (WHERE is_complete)')} AS efficiency
  FROM aligned GROUP BY generator_model""")
def _(d: Data):
    return V.agreement_funnel(aligned(d), "majority")


# every seventh line is a failed generation in this one
@query("generation_success_filter", W + f""", f AS (SELECT generator_model AS g, content_key AS c, line_no FROM last WHERE verifier_model = 'claude')
SELECT {G} FROM full_groups JOIN f ON g = generator_model AND c = content_key WHERE una AND line_no % 7 <> 0""")
def _(d: Data):
    votes = d.votes().withColumn("generation_successful", F.col("line_no") % 7 != 0)
    return V.generation_success_filter(V.unanimous_filter(V.align(votes))).select(*V.GROUP)


@query("label_distribution", W + f""", {KEPT}, l AS (SELECT *, CASE WHEN intensity = 'LOW' THEN 'ANSWER_CORRECTLY' ELSE CASE perturbation_class
  WHEN 'P-Ambiguity' THEN 'REFUSE_AMBIGUOUS_QUERY' WHEN 'P-Contradiction' THEN 'REFUSE_CONTRADICTORY_CONTEXT' WHEN 'P-MissingInfo' THEN 'REFUSE_INFO_MISSING_IN_CONTEXT'
  WHEN 'P-FalsePremise' THEN 'REFUSE_FALSE_PREMISE_IN_QUERY' WHEN 'P-GranularityMismatch' THEN 'REFUSE_GRANULARITY_MISMATCH' ELSE 'REFUSE_NONFACTUAL_QUERY' END END AS label FROM kept)
SELECT 'class' AS dimension, perturbation_class AS value, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT 'intensity', intensity, count(*) FROM l GROUP BY ALL
UNION ALL SELECT 'label', label, count(*) FROM l GROUP BY ALL""")
def _(d: Data):
    return V.label_distribution(kept(d))


PAIRS = LAST + """, ord(v, i) AS (VALUES ('claude', 0), ('nova', 1), ('gpt', 2), ('deepseek', 3)),
vp AS (SELECT a.generator_model, a.content_key, a.verifier_model AS verifier_a, b.verifier_model AS verifier_b, a.result AS result_a, b.result AS result_b
  FROM tagged a JOIN tagged b ON a.generator_model = b.generator_model AND a.content_key = b.content_key
  JOIN ord x ON x.v = a.verifier_model JOIN ord y ON y.v = b.verifier_model WHERE x.i < y.i)"""
FULLPAIRS = W.replace(LAST, PAIRS) + """, fp AS (SELECT vp.* FROM vp JOIN full_groups USING (generator_model, content_key))"""


@query("verifier_pairs", f"WITH {PAIRS} SELECT * FROM vp")
def _(d: Data):
    return V.verifier_pairs(aligned(d))


MATRIX = """matrix AS (SELECT generator_model, verifier_model, count(*) AS total, count(*) FILTER (WHERE result = 'PASS') AS pass,
  count(*) FILTER (WHERE result = 'FAIL') AS fail, count(*) FILTER (WHERE result = 'ERROR') AS error FROM tagged
  JOIN (SELECT generator_model, content_key FROM full_groups) USING (generator_model, content_key) GROUP BY ALL)"""
WM = W + ", " + MATRIX + " "


def matrix(d: Data):
    return A.pass_rate_matrix(full(d))


@query("pass_rate_matrix", WM + f"SELECT *, {pct('pass', 'total')} AS pass_rate FROM matrix")
def _(d: Data):
    return matrix(d)


SIDES = """sides AS (SELECT generator_model, CAST(coalesce(sum(pass) FILTER (WHERE generator_model = verifier_model), 0) AS BIGINT) AS sp,
  CAST(coalesce(sum(total) FILTER (WHERE generator_model = verifier_model), 0) AS BIGINT) AS st,
  CAST(coalesce(sum(pass) FILTER (WHERE generator_model <> verifier_model), 0) AS BIGINT) AS cp,
  CAST(coalesce(sum(total) FILTER (WHERE generator_model <> verifier_model), 0) AS BIGINT) AS ct FROM matrix GROUP BY ALL)"""
SVC = f"""svc AS (SELECT generator_model, {pct('sp', 'st')} AS self_pass_rate, {pct('cp', 'ct')} AS cross_pass_rate, st AS self_total, ct AS cross_total FROM sides)"""
SVC_OUT = """SELECT *, self_pass_rate - cross_pass_rate AS self_bias, CASE WHEN self_pass_rate - cross_pass_rate > 5 THEN 'self_favorable'
  WHEN self_pass_rate - cross_pass_rate < -5 THEN 'cross_favorable' ELSE 'neutral' END AS interpretation FROM svc"""


@query("self_vs_cross", WM + f", {SIDES}, {SVC} {SVC_OUT}")
def _(d: Data):
    return A.self_vs_cross(matrix(d))


BIAS = """bias AS (SELECT verifier_model, avg(CAST(pass AS DOUBLE) / total) FILTER (WHERE generator_model = verifier_model) AS own,
  avg(CAST(pass AS DOUBLE) / total) FILTER (WHERE generator_model <> verifier_model) AS oth FROM matrix GROUP BY ALL)"""


@query("verifier_bias", WM + f""", {BIAS} SELECT verifier_model, round(own, 9) AS own_pass_rate, round(oth, 9) AS other_pass_rate, round(own - oth, 9) AS bias_score
FROM bias WHERE own IS NOT NULL AND oth IS NOT NULL""")
def _(d: Data):
    return rounded(A.verifier_bias(matrix(d)), "own_pass_rate", "other_pass_rate", "bias_score")


@query("bias_ranking", WM + f""", {BIAS} SELECT verifier_model, round(own - oth, 9) AS bias_score, round(abs(own - oth), 9) AS bias_magnitude,
  CASE WHEN own > oth THEN 'self_favorable' ELSE 'other_favorable' END AS bias_direction FROM bias""")
def _(d: Data):
    return rounded(A.bias_ranking(A.verifier_bias(matrix(d))), "bias_score", "bias_magnitude")


AGREE = FULLPAIRS + f""", ag AS (SELECT verifier_a || '_' || verifier_b AS verifier_pair,
  count(*) FILTER (WHERE result_a = result_b AND result_a IN ('PASS', 'FAIL')) AS agree,
  count(*) FILTER (WHERE result_a <> result_b AND result_a IN ('PASS', 'FAIL') AND result_b IN ('PASS', 'FAIL')) AS disagree FROM fp GROUP BY ALL),
ar AS (SELECT *, agree + disagree AS total_comparisons, {pct('agree', '(agree + disagree)')} AS agreement_rate FROM ag)"""


@query("pairwise_agreement", AGREE + """SELECT *, CASE WHEN agreement_rate > 80 THEN 'high' WHEN agreement_rate > 60 THEN 'medium' ELSE 'low' END AS agreement_strength
FROM ar WHERE total_comparisons > 0""")
def _(d: Data):
    return A.pairwise_agreement(full(d))


@query("agreement_extremes", AGREE + """SELECT CASE WHEN agreement_rate > 80 THEN 'high_agreement' ELSE 'high_disagreement' END AS kind, verifier_pair, agreement_rate, total_comparisons
FROM ar WHERE total_comparisons >= 10 AND (agreement_rate > 80 OR agreement_rate < 50)""")
def _(d: Data):
    return A.agreement_extremes(A.pairwise_agreement(full(d)))


@query("disagreement_patterns", FULLPAIRS + """SELECT verifier_a || '_' || verifier_b AS verifier_pair, result_a || '_vs_' || result_b AS pattern, count(*) AS n
FROM fp WHERE result_a <> result_b AND result_a IN ('PASS', 'FAIL') AND result_b IN ('PASS', 'FAIL') GROUP BY ALL""")
def _(d: Data):
    return A.disagreement_patterns(full(d))


def _eff(name: str, c: str) -> str:
    return (f"SELECT generator_model, '{name}' AS dimension, {c} AS value, count(*) AS total_attempts, count(*) FILTER (WHERE una) AS successful_perturbations, "
            f"{pct('count(*) FILTER (WHERE una)', 'count(*)')} AS success_rate FROM full_groups GROUP BY generator_model, {c}")


EFF = "eff AS (" + " UNION ALL ".join(_eff(n, c) for n, c in (("class", "perturbation_class"), ("intensity", "intensity"), ("lever", "lever_selected"))) + ")"
SPEC = """sp0 AS (SELECT *, row_number() OVER (PARTITION BY dimension, value ORDER BY success_rate DESC, generator_model) AS rk,
  lead(success_rate) OVER (PARTITION BY dimension, value ORDER BY success_rate DESC, generator_model) AS nx,
  count(*) OVER (PARTITION BY dimension, value) AS cn FROM eff WHERE total_attempts >= 5),
spec AS (SELECT dimension, value, generator_model AS best_generator, success_rate AS best_success_rate, success_rate - nx AS performance_gap
  FROM sp0 WHERE rk = 1 AND cn > 1 AND success_rate > 0)"""


@query("effectiveness", W + f", {EFF} SELECT * FROM eff")
def _(d: Data):
    return A.effectiveness(full(d))


@query("specialisation", W + f", {EFF}, {SPEC} SELECT * FROM spec")
def _(d: Data):
    return A.specialisation(A.effectiveness(full(d)))


EFFIC = f"""fe AS (SELECT generator_model, count(*) AS total_generated, count(*) FILTER (WHERE una) AS passed_filtering,
  {pct('count(*) FILTER (WHERE una)', 'count(*)')} AS filtering_efficiency FROM full_groups GROUP BY ALL)"""


@query("filtering_efficiency", W + f", {EFFIC} SELECT * FROM fe")
def _(d: Data):
    return A.filtering_efficiency(full(d))


@query("generator_comparison", W + f", {EFFIC} SELECT generator_model, total_generated AS total_perturbations_generated, passed_filtering AS high_quality_examples, filtering_efficiency AS success_rate FROM fe")
def _(d: Data):
    return A.generator_comparison(A.filtering_efficiency(full(d)))


@query("quality_metrics", W + f""", pv AS (SELECT t.* FROM tagged t JOIN full_groups f USING (generator_model, content_key) WHERE t.result = 'PASS')
SELECT generator_model, {pct('count(*) FILTER (WHERE lever_correctly_implemented)', 'count(*)')} AS lever_correctness,
  {pct('count(*) FILTER (WHERE intensity_correctly_achieved)', 'count(*)')} AS intensity_correctness,
  {pct('count(*) FILTER (WHERE uncertainty_successfully_induced)', 'count(*)')} AS uncertainty_induction, count(*) AS sample_size FROM pv GROUP BY ALL""")
def _(d: Data):
    return A.quality_metrics(full(d))


@query("generator_ranking", WM + f", {SIDES} SELECT generator_model, {pct('(sp + cp)', '(st + ct)')} AS overall_pass_rate, st + ct AS total_evaluations FROM sides WHERE st > 0")
def _(d: Data):
    return A.generator_ranking(matrix(d))


@query("top_pairs", WM + f"""SELECT generator_model, verifier_model, {pct('pass', 'total')} AS pass_rate, total AS sample_size, generator_model = verifier_model AS is_self_verification
FROM matrix WHERE total >= 10 ORDER BY pass_rate DESC, generator_model, verifier_model LIMIT 10""")
def _(d: Data):
    return A.top_pairs(matrix(d))


@query("verifier_reliability", WM + f""", v AS (SELECT verifier_model, CAST(sum(total) AS BIGINT) AS t, CAST(sum(pass) AS BIGINT) AS p, CAST(sum(fail) AS BIGINT) AS f,
  CAST(sum(error) AS BIGINT) AS e FROM matrix GROUP BY ALL) SELECT verifier_model, t AS total_evaluations, {pct('p', 't')} AS pass_rate, {pct('f', 't')} AS fail_rate,
  {pct('e', 't')} AS error_rate, {pct('(p + f)', 't')} AS reliability_score FROM v""")
def _(d: Data):
    return A.verifier_reliability(matrix(d))


@query("category_distribution", W + f""", {KEPT}, u AS (SELECT 'class' AS dimension, perturbation_class AS value, count(*) AS n FROM kept GROUP BY ALL
  UNION ALL SELECT 'intensity', intensity, count(*) FROM kept GROUP BY ALL UNION ALL SELECT 'lever', lever_selected, count(*) FROM kept GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY dimension) AS distinct_values FROM u""")
def _(d: Data):
    return A.category_distribution(kept(d))


@query("report_tables", WM + f""", mr AS (SELECT *, {pct('pass', 'total')} AS r FROM matrix),
w AS (SELECT generator_model, coalesce(max(r) FILTER (WHERE verifier_model = 'claude'), 0) AS claude, coalesce(max(r) FILTER (WHERE verifier_model = 'nova'), 0) AS nova,
  coalesce(max(r) FILTER (WHERE verifier_model = 'gpt'), 0) AS gpt, coalesce(max(r) FILTER (WHERE verifier_model = 'deepseek'), 0) AS deepseek FROM mr GROUP BY ALL)
SELECT *, (claude + nova + gpt + deepseek) / 4 AS average FROM w""")
def _(d: Data):
    return A.effectiveness_table(matrix(d))


@query("report_table_self_vs_cross", WM + f", {SIDES}, {SVC}, o AS ({SVC_OUT})" + """ SELECT generator_model, printf('%.1f%%', self_pass_rate) AS self_pass_rate,
  printf('%.1f%%', cross_pass_rate) AS cross_pass_rate, printf('%.1f%%', self_bias) AS self_bias, interpretation FROM o""")
def _(d: Data):
    t = A.self_vs_cross(matrix(d)).drop("self_total", "cross_total")
    return A.printable(t, ["self_pass_rate", "cross_pass_rate", "self_bias"])


@query("report_table_specialisation", W + f", {EFF}, {SPEC} SELECT * FROM spec WHERE performance_gap > 5")
def _(d: Data):
    return A.specialisation_table(A.specialisation(A.effectiveness(full(d))))


@query("matrix_self_bias", WM + f""", mr AS (SELECT *, {pct('pass', 'total')} AS r FROM matrix),
b AS (SELECT generator_model, avg(r) FILTER (WHERE generator_model = verifier_model) - avg(r) FILTER (WHERE generator_model <> verifier_model) AS x FROM mr GROUP BY ALL)
SELECT generator_model, round(x, 9) AS self_bias FROM b WHERE x IS NOT NULL UNION ALL SELECT 'mean', round(avg(x), 9) FROM b""")
def _(d: Data):
    return rounded(A.matrix_self_bias(matrix(d)), "self_bias")


@query("class_mastery", W + f"""SELECT perturbation_class, {pct('sum(pass_votes)', 'sum(responding)')} AS pass_rate,
  {pct('count(*) FILTER (WHERE una)', 'count(*)')} AS unanimous_rate, CAST(sum(responding) AS BIGINT) AS evaluations FROM full_groups GROUP BY ALL""")
def _(d: Data):
    return A.class_mastery(full(d))


@query("verification_coverage", W + """SELECT count(*) AS contents, count(*) FILTER (WHERE is_complete) AS complete,
  CAST(count(*) FILTER (WHERE is_complete) AS DOUBLE) / count(*) AS coverage, CAST(sum(responding) AS BIGINT) AS total_evaluations FROM aligned""")
def _(d: Data):
    return A.verification_coverage(aligned(d))


@query("generation_stats", f"""WITH p AS (SELECT *, line_no % 7 <> 0 AS ok FROM verifications),
t AS (SELECT perturbation_class, intensity, count(*) AS a, count(*) FILTER (WHERE ok) AS s FROM p GROUP BY GROUPING SETS ((), (perturbation_class, intensity)))
SELECT coalesce(perturbation_class, 'all') AS perturbation_class, coalesce(intensity, 'all') AS intensity, a AS attempts, s AS successes, a - s AS failures, {pct('s', 'a')} AS success_rate FROM t""")
def _(d: Data):
    log = d.votes().withColumn("generation_successful", F.col("line_no") % 7 != 0)
    return A.generation_stats(log)


@query("verification_stats", f"""WITH t AS (SELECT verifier_model, perturbation_class, intensity, count(*) AS total, count(*) FILTER (WHERE generation_successful) AS generated,
  count(*) FILTER (WHERE verification_successful) AS verified, count(*) FILTER (WHERE verification_result = 'PASS') AS passed
  FROM verifications GROUP BY GROUPING SETS ((verifier_model), (verifier_model, perturbation_class, intensity)))
SELECT verifier_model, coalesce(perturbation_class, 'all') AS perturbation_class, coalesce(intensity, 'all') AS intensity, total, generated, verified, passed,
  {pct('generated', 'total')} AS generation_rate, {pct('verified', 'total')} AS verification_rate, {pct('passed', 'verified')} AS pass_rate FROM t""")
def _(d: Data):
    return A.verification_stats(d.votes())


# --- keys --------------------------------------------------------------------------------


@query("stratum_key", "SELECT generator_model, line_no, verifier_model, coalesce(CASE WHEN line_no % 11 <> 0 THEN perturbation_class END, 'unknown') || '_' || upper(coalesce(CASE WHEN line_no % 13 <> 0 THEN lower(intensity) END, 'unknown')) AS stratum FROM verifications")
def _(d: Data):
    cls = F.when(F.col("line_no") % 11 != 0, F.col("perturbation_class"))
    return d.votes().select("generator_model", "line_no", "verifier_model", K.stratum_key(cls, F.when(F.col("line_no") % 13 != 0, F.lower("intensity"))).alias("stratum"))


@query("content_id", f"SELECT generator_model, verifier_model, line_no, {READABLE} AS content_id, md5({CONTENT}) AS content_key FROM verifications")
def _(d: Data):
    return d.votes().select("generator_model", "verifier_model", "line_no", K.content_id().alias("content_id"), K.content_key().alias("content_key"))


TASK = "concat_ws('|', source_qid, original_query, perturbation_class, intensity, md5(original_context))"
TASK_KEY = exact("l.source_qid", "original_query", "l.perturbation_class", "l.intensity", "original_context")


@query("task_id", f"SELECT generator_model, verifier_model, line_no, {TASK} AS task_id FROM verifications")
def _(d: Data):
    return d.votes().select("generator_model", "verifier_model", "line_no", K.task_id().alias("task_id"))


@query("perturbation_id", """SELECT generator_model, verifier_model, line_no, concat_ws('|', original_query, perturbation_class, intensity, substring(original_context, 1, 100)) AS single_id,
  concat_ws('|', source_qid, perturbation_class, intensity, substring(original_query, 1, 50)) AS multi_id FROM verifications""")
def _(d: Data):
    ids = K.perturbation_id("single", 100).alias("single_id"), K.perturbation_id("multi", 50).alias("multi_id")
    return d.votes().select("generator_model", "verifier_model", "line_no", *ids)


@query("resume_key", f"""SELECT generator_model, verifier_model, line_no, md5({exact("generator_model", "source_qid", "original_query", "original_context", "perturbation_class",
  "intensity", "lever_selected", "perturbed_query", "perturbed_context")}) AS resume_key FROM verifications""")
def _(d: Data):
    return d.votes().select("generator_model", "verifier_model", "line_no", K.perturbation_id().alias("resume_key"))


def _counter(prefix: str, ident: str) -> str:
    """Plain ordinal within the prefix."""
    return f"row_number() OVER (PARTITION BY {prefix} ORDER BY {ident})"


UKEY = "concat_ws('_', 'RB', generator_model, source_qid, perturbation_class, intensity, substring(md5(concat_ws('|||', perturbed_query, perturbed_context, generator_model)), 1, 8))"


@query("unique_key", f"""WITH v AS (SELECT *, {UKEY} AS pre, verifier_model || ':' || line_no AS ident FROM verifications), n AS (SELECT *, {_counter('pre', 'ident')} AS c FROM v)
SELECT generator_model, verifier_model, line_no, pre || '_' || CASE WHEN c < 1000 THEN lpad(CAST(c AS STRING), 4, '0') ELSE CAST(c AS STRING) END AS unique_id FROM n""")
def _(d: Data):
    rows = d.votes().withColumn("ident", F.concat_ws(":", "verifier_model", "line_no"))
    return K.unique_key(rows, ident="ident").select("generator_model", "verifier_model", "line_no", "unique_id")


# --- selection ------------------------------------------------------------------------------


@query("base_verification", LAST.join(["WITH ", ""]) + """, ord AS (SELECT *, row_number() OVER (PARTITION BY generator_model, content_key ORDER BY verifier_ord) AS o FROM last)
SELECT generator_model, content_key, verifier_model, line_no, original_query, perturbed_query, perturbed_context, verification_result FROM ord WHERE o = 1""")
def _(d: Data):
    return V.base_verification(d.votes(), aligned(d)).select(
        "generator_model", "content_key", "verifier_model", "line_no", "original_query", "perturbed_query", "perturbed_context", "verification_result"
    )


COMMON = W + f""", {KEPT}, tk AS (SELECT k.generator_model, k.content_key, l.line_no, md5({TASK_KEY}) AS task_key
  FROM kept k JOIN last l ON l.generator_model = k.generator_model AND l.content_key = k.content_key AND l.verifier_model = 'claude'),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY generator_model, task_key ORDER BY line_no DESC, content_key DESC) AS rn FROM tk) WHERE rn = 1),
common AS (SELECT generator_model, content_key, line_no, task_key FROM one WHERE task_key IN
  (SELECT task_key FROM one GROUP BY task_key HAVING count(DISTINCT generator_model) = (SELECT count(DISTINCT generator_model) FROM kept))
  AND (SELECT count(DISTINCT generator_model) FROM kept) >= 2)"""


@query("common_tasks", COMMON + "SELECT * FROM common")
def _(d: Data):
    return V.common_tasks(d.votes(), kept(d))


@query("intersect_tasks", COMMON + "SELECT DISTINCT task_key FROM common")
def _(d: Data):
    return V.intersect_tasks(d.votes(), kept(d))


@query("task_sample", COMMON + "SELECT * FROM common WHERE task_key IN (SELECT task_key FROM (SELECT DISTINCT task_key FROM common) ORDER BY md5('42:' || task_key), task_key LIMIT 30)")
def _(d: Data):
    return S.task_sample(V.common_tasks(d.votes(), kept(d)), 30)


def sample_sql(per: int = 22, target: int = 400) -> str:
    return W + f""", {KEPT}, h AS (SELECT *, md5('42:' || content_key) AS hh, perturbation_class || '_' || intensity AS stratum FROM kept),
q AS (SELECT *, row_number() OVER (PARTITION BY generator_model, stratum ORDER BY hh, content_key) AS a FROM h),
t AS (SELECT *, count(*) FILTER (WHERE a <= {per}) OVER (PARTITION BY generator_model) AS taken, row_number() OVER (PARTITION BY generator_model, a <= {per} ORDER BY hh, content_key) AS b FROM q),
samp AS (SELECT * FROM t WHERE a <= {per} OR b <= {target} - taken)"""


def sample(d: Data):
    return S.stratified_sample(written(d))


@query("stratified_sample", sample_sql() + "SELECT generator_model, content_key, perturbation_class, intensity FROM samp")
def _(d: Data):
    return sample(d).select("generator_model", "content_key", "perturbation_class", "intensity")


# strata run short here: fewer rows than the quota, a large fill
@query("stratified_sample_fill", sample_sql(60, 800) + "SELECT generator_model, content_key, stratum FROM samp")
def _(d: Data):
    return S.stratified_ids(written(d), per_stratum=60, target=800)


# more than a thousand rows per generator
@query("stratified_sample_large", sample_sql(150, 1500) + "SELECT generator_model, content_key, stratum FROM samp")
def _(d: Data):
    return S.stratified_ids(written(d), per_stratum=150, target=1500)


@query("stratification_report", sample_sql() + """SELECT stratum, TRUE AS expected, count(*) AS count, count(DISTINCT generator_model) AS models_represented,
  count(DISTINCT generator_model) >= 3 AS is_balanced, CASE WHEN count(*) >= 88 THEN 'met' ELSE 'below' END AS status FROM samp GROUP BY stratum""")
def _(d: Data):
    return S.stratification_report(sample(d))


@query("stratification_summary", sample_sql() + """, r AS (SELECT stratum, count(*) AS n, count(DISTINCT generator_model) AS m FROM samp GROUP BY stratum)
SELECT count(*) AS covered_strata, 18::BIGINT AS total_strata, count(*) FILTER (WHERE n >= 88) AS strata_meeting_minimum, count(*) FILTER (WHERE n < 88) AS strata_below_minimum,
  count(*) FILTER (WHERE m >= 3) AS balanced_strata, CAST(sum(n) AS BIGINT) AS total_samples, CAST(count(*) AS DOUBLE) / 18 * 100::DOUBLE AS coverage_percentage FROM r""")
def _(d: Data):
    return S.stratification_summary(S.stratification_report(sample(d)))


@query("stratification_models", sample_sql() + """SELECT generator_model, count(*) AS sample_count, count(*) - 400 AS deviation_from_target, count(DISTINCT stratum) AS strata_covered,
  '' AS missing_strata FROM samp GROUP BY generator_model""")
def _(d: Data):
    return S.stratification_models(sample(d)).withColumn("missing_strata", F.array_join("missing_strata", ","))


@query("sample_crosstab", sample_sql() + "SELECT coalesce(stratum, 'all') AS stratum, coalesce(generator_model, 'all') AS generator_model, count(*) AS n FROM samp GROUP BY CUBE (stratum, generator_model)")
def _(d: Data):
    return S.sample_crosstab(sample(d))


# without the rows of one class per generator some strata are missing
@query("missing_strata", W + f""", {KEPT}, s AS (SELECT *, perturbation_class || '_' || intensity AS stratum FROM kept WHERE NOT (generator_model = 'gpt' AND perturbation_class = 'P-Ambiguity')
  AND NOT (perturbation_class = 'P-MissingInfo' AND intensity = 'HIGH')), c AS (SELECT DISTINCT perturbation_class || '_' || intensity AS stratum FROM kept),
g AS (SELECT DISTINCT generator_model FROM s)
SELECT generator_model, c.stratum FROM g, c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.generator_model = g.generator_model AND s.stratum = c.stratum)
UNION ALL SELECT 'all', stratum FROM c WHERE stratum NOT IN (SELECT stratum FROM s)""")
def _(d: Data):
    rows = kept(d).filter("NOT (generator_model = 'gpt' AND perturbation_class = 'P-Ambiguity') AND NOT (perturbation_class = 'P-MissingInfo' AND intensity = 'HIGH')")
    return S.missing_strata(rows)


@query("run_metadata", sample_sql() + """SELECT count(*) AS total_entries, count(DISTINCT generator_model) AS generators, count(DISTINCT stratum) AS strata,
  'unanimous_agreement_stratified_sampling' AS filtering_strategy, 400::INT AS target_samples_per_model, 22::INT AS min_samples_per_stratum_per_model, 18::INT AS num_strata,
  42::INT AS random_seed, 'claude,nova,gpt,deepseek' AS verifier_models FROM samp""")
def _(d: Data):
    return S.run_metadata(sample(d), "unanimous")


@query("distinct_values", WM + """SELECT DISTINCT 'generator' AS kind, generator_model AS value FROM matrix UNION SELECT DISTINCT 'task', source_qid FROM verifications""")
def _(d: Data):
    generators = V.voting_generators(matrix(d)).select(F.lit("generator").alias("kind"), F.col("generator_model").alias("value"))
    return generators.union(V.distinct_values(d.votes(), "source_qid").select(F.lit("task"), "source_qid"))


@query("annotate_verification", f"""SELECT line_no, generator_model, verifier_model, md5({CONTENT}) AS content_key,
  CASE generator_model WHEN 'claude' THEN 'claude-sonnet-4' WHEN 'deepseek' THEN 'deepseek-r1' WHEN 'gpt' THEN 'gpt-4o' ELSE 'amazon-nova-pro' END AS generator_model_full,
  CASE verifier_model WHEN 'claude' THEN 'bedrock/us.anthropic.claude-sonnet-4-20250514-v1:0' WHEN 'nova' THEN 'bedrock/us.amazon.nova-pro-v1:0'
    WHEN 'gpt' THEN 'openai/gpt-4o-2024-08-06' ELSE 'bedrock/converse/us.deepseek.r1-v1:0' END AS verifier_model_full, 'dataset_' || generator_model AS source_folder FROM verifications""")
def _(d: Data):
    return V.annotate(d.votes()).select(
        "line_no", "generator_model", "verifier_model", "content_key", "generator_model_full", "verifier_model_full", "source_folder"
    )


UPRE = UKEY.replace("generator_model,", "k.generator_model,", 1)


@query("unified_record", W + f""", {KEPT}, r AS (SELECT l.*, k.pass_votes, k.fail_votes FROM kept k JOIN last l ON l.generator_model = k.generator_model AND l.content_key = k.content_key AND l.verifier_model = 'claude'),
p AS (SELECT *, {UKEY} AS pre FROM r), n AS (SELECT *, {_counter('pre', 'content_key')} AS c FROM p),
lev AS (SELECT generator_model, content_key, count(*) FILTER (WHERE lever_correctly_implemented) AS levers_ok FROM tagged GROUP BY ALL)
SELECT pre || '_' || CASE WHEN c < 1000 THEN lpad(CAST(c AS STRING), 4, '0') ELSE CAST(c AS STRING) END AS unique_id, n.generator_model, 'dataset_' || n.generator_model AS source_folder,
  source_qid, original_query, original_context, perturbed_query, perturbed_context, perturbation_class, intensity, lever_selected, n.content_key,
  perturbation_class || '_' || intensity AS stratum_key, 4::INT AS verifiers, CAST(levers_ok AS INT) AS levers_ok, pass_votes + fail_votes AS valid_votes, TRUE AS unanimous_pass, 'unanimous' AS filtering_mode
FROM n JOIN lev ON lev.generator_model = n.generator_model AND lev.content_key = n.content_key""")
def _(d: Data):
    votes = d.votes()
    u = UN.unified_record(votes, V.unanimous_filter(V.align(votes)), "unanimous")
    levers = F.size(F.filter(F.map_values("verification_results"), lambda v: v["lever_correctly_implemented"]))
    stats = F.col("agreement_analysis")["agreement_statistics"]
    return u.select(
        "unique_id", "generator_model", "source_folder", "source_qid", "original_query", "original_context", "perturbed_query", "perturbed_context",
        "perturbation_class", "intensity", "lever_selected", "content_key", "stratum_key", F.size("verification_results").alias("verifiers"),
        levers.alias("levers_ok"), stats["total_valid_verifications"].alias("valid_votes"), stats["unanimous_pass"].alias("unanimous_pass"), "filtering_mode",
    )


ORIG = """d.retrieved_docs"""


def originals(d: Data):
    docs = F.filter(F.array("doc0", "doc1"), lambda x: x.isNotNull())
    return d.fixture("originals").select("qid", "answer", docs.alias("retrieved_docs"), F.regexp_extract("qid", r"\d+", 0).cast("long").alias("line_no"))


@query("join_original", W + f""", {KEPT}, r AS (SELECT l.* FROM kept k JOIN last l ON l.generator_model = k.generator_model AND l.content_key = k.content_key AND l.verifier_model = 'claude')
SELECT r.generator_model, r.content_key, r.source_qid, o.qid IS NOT NULL AS has_original, o.answer,
  CASE WHEN o.qid IS NOT NULL THEN r.perturbed_context || CASE WHEN o.doc1 IS NULL THEN '' ELSE '#' || o.doc1 END END AS retrieved_docs FROM r LEFT JOIN originals o ON o.qid = r.source_qid""")
def _(d: Data):
    rows = V.representatives(d.votes(), kept(d)).drop("line_no")
    return UN.join_original(rows, originals(d)).select(
        "generator_model", "content_key", "source_qid", "has_original", "answer", F.array_join("retrieved_docs", "#").alias("retrieved_docs")
    )
