"""Rules the fixtures do not reach, on tables small enough to check by hand."""

import pytest
from pyspark.sql import functions as F

from demur import vocab
from demur.functions import keys as K
from demur.operators import matching as J
from demur.operators import metrics as M
from demur.operators import multidoc as MD
from demur.operators import parsing as R
from demur.operators import passages as P
from demur.operators import prompts as T
from demur.operators import records as RC
from demur.operators import sampling as S
from demur.operators import unified as UN
from demur.operators import voting as V
from demur.sources import catalogue as C

RESULT = "model_id string, ground_truth_label string, model_predicted_type string, answer_quality_score double, refusal_match_correct boolean, intensity string, perturbation_class string, confidence_level string"


def results(spark, rows):
    return spark.createDataFrame([(*r, "HIGH", "P-Ambiguity", "CONFIDENT") for r in rows], RESULT)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- metrics ---------------------------------------------------------------------------------

A, RA, RO = "ANSWER_CORRECTLY", "REFUSE_AMBIGUOUS_QUERY", "REFUSE_OTHER"


def test_empty_sides_give_zero(spark):
    only_answerable = one(M.leaderboard(results(spark, [("m", A, "answer_attempt", 5.0, None)])))
    assert (only_answerable.answer_accuracy, only_answerable.refusal_accuracy, only_answerable.refusal_detection_f1) == (1.0, 0.0, 0.0)
    only_refusals = one(M.leaderboard(results(spark, [("m", RA, RA, None, True)])))
    assert (only_refusals.answer_accuracy, only_refusals.refusal_accuracy, only_refusals.category_accuracy) == (0.0, 1.0, 1.0)


def test_errors_count_differently_in_the_two_definitions(spark):
    rows = results(spark, [("m", RA, RA, None, True), ("m", RA, "ERROR", None, None), ("m", A, "ERROR", None, None)])
    board, evaluator = one(M.leaderboard(rows)), one(M.evaluator_metrics(rows))
    assert board.refusal_accuracy == 1.0 and evaluator.refusal_accuracy == 0.5
    assert board.false_refusal_rate == 1.0 and evaluator.false_refusal_rate == 0.0
    assert board.overall_refusal_rate == 1.0 and evaluator.overall_refusal_rate == 0.5


def test_model_with_errors_only(spark):
    r = one(M.leaderboard(results(spark, [("m", RA, "ERROR", None, None)])))
    assert r.refusal_accuracy is None and r.calibrated_refusal_score is None and r.total_instances == 1


def test_score_below_four_or_missing_is_not_correct(spark):
    rows = [("m", A, "answer_attempt", s, None) for s in (5.0, 4.0, 3.9, None)]
    assert one(M.leaderboard(results(spark, rows))).answer_accuracy == 0.5


def test_calibration_ignores_unknown_levels_except_in_the_divisor_of_the_parts(spark):
    rows = results(spark, [("m", A, "answer_attempt", 5.0, None), ("m", A, "answer_attempt", 1.0, None)])
    rows = rows.withColumn("confidence_level", F.when(F.col("answer_quality_score") > 4, "CONFIDENT").otherwise("NO_IDEA"))
    assert abs(one(M.calibration_error(rows)).expected_calibration_error - 0.2) < 1e-12
    assert abs(one(M.calibration_decomposed(rows)).ece_answer - 0.1) < 1e-12


def test_calibration_needs_its_column(spark):
    with pytest.raises(ValueError):
        M.calibration_error(results(spark, [("m", A, "ERROR", None, None)]).drop("confidence_level"))


def test_condensed_results_give_the_same_tables(spark):
    rows = results(spark, [("m", A, "answer_attempt", s, None) for s in (1.0, 4.0, 5.0, None)] + [("m", RA, RO, None, False), ("n", RA, RA, None, True)] * 3)
    small = M.condense(rows)
    for f in (M.leaderboard, M.evaluator_metrics, M.calibration_error, M.calibration_decomposed, M.cohen_kappa, M.refusal_by_class, M.refusal_by_intensity, M.detailed_results, M.confusion_matrix, M.coverage_matrix):
        assert sorted(map(str, f(rows).collect())) == sorted(map(str, f(small).collect())), f.__name__


def test_kappa_of_perfect_and_constant_agreement(spark):
    perfect = one(M.cohen_kappa(results(spark, [("m", RA, RA, None, True), ("m", RO, RO, None, True)])))
    assert perfect.cohen_kappa == 1.0
    assert one(M.cohen_kappa(results(spark, [("m", RA, RA, None, True)]))).cohen_kappa == 0.0


def test_rates_stay_in_range_and_crs_between_its_parts(spark):
    rows = [("m", A if i % 3 else RA, ("answer_attempt", RA, RO, "ERROR")[i % 4], float(i % 5 + 1), bool(i % 2)) for i in range(60)]
    r = one(M.leaderboard(results(spark, rows)))
    for c in ("answer_accuracy", "refusal_accuracy", "refusal_precision", "refusal_recall", "refusal_detection_f1", "category_accuracy"):
        assert 0 <= r[c] <= 1
    low, high = sorted((r.answer_accuracy, r.refusal_accuracy))
    assert low <= r.calibrated_refusal_score <= high


def test_hybrid_score_falls_back_to_the_side_that_exists(spark):
    t = spark.createDataFrame([("a", 2, 0, 0.5, 0.0), ("b", 0, 2, 0.0, 0.25), ("c", 0, 0, 0.0, 0.0), ("d", 1, 3, 1.0, 0.0)], "model_id string, num_answerable bigint, num_unanswerable bigint, raf double, refusal_accuracy double")
    assert {r.model_id: r.hybrid_score for r in MD.hybrid_score(t).collect()} == {"a": 0.5, "b": 0.25, "c": 0.0, "d": 0.25}


# --- votes -------------------------------------------------------------------------------------

VOTE = "generator_model string, verifier_model string, line_no bigint, source_qid string, perturbed_query string, perturbed_context string, perturbation_class string, intensity string, lever_selected string, verification_successful boolean, verification_result string, generation_successful boolean"


def votes(spark, given, generator="gpt", q="pq"):
    rows = [(generator, v, line, "q1", q, "pc", "P-Ambiguity", "LOW", "lever", res is not None, res, True) for v, line, res in given]
    return spark.createDataFrame(rows, VOTE)


def test_one_pass_and_three_errors_is_a_majority_but_not_unanimous(spark):
    a = V.align(votes(spark, [("claude", 1, "PASS"), ("nova", 1, None), ("gpt", 1, None), ("deepseek", 1, None)]))
    assert V.majority_filter(a).count() == 1 and V.unanimous_filter(a).count() == 0
    assert V.valid_vote_filter(a, "all_agree").count() == 1


def test_no_successful_vote_is_no_majority(spark):
    a = V.align(votes(spark, [(v, 1, None) for v in vocab.VERIFIERS]))
    assert V.majority_filter(a).count() == 0 and V.valid_vote_filter(a, "majority_agree").count() == 0
    assert one(V.vote_statistics(a)).pass_percentage is None


def test_half_is_not_a_majority(spark):
    a = V.align(votes(spark, [("claude", 1, "PASS"), ("nova", 1, "PASS"), ("gpt", 1, "FAIL"), ("deepseek", 1, "FAIL")]))
    assert V.majority_filter(a).count() == 0


def test_last_line_wins_whatever_the_order(spark):
    a = one(V.align(votes(spark, [("claude", 7, "FAIL"), ("claude", 30, "PASS"), ("claude", 4, None)])))
    assert a.votes[0].result == "PASS" and a.votes[0].line_no == 30
    assert [v.result for v in a.votes[1:]] == ["MISSING"] * 3 and not a.is_complete


def test_flags_and_label_survive_packing(spark):
    v = votes(spark, [("claude", 2**40, "PASS")]).withColumns({
        "lever_correctly_implemented": F.lit(True), "intensity_correctly_achieved": F.lit(False),
        "uncertainty_successfully_induced": F.lit(None).cast("boolean"), "answer_constraint_satisfied": F.lit(True),
        "final_ground_truth_label": F.lit("REFUSE_GRANULARITY_MISMATCH"),
    })
    x = one(V.align(v)).votes[0]
    assert (x.lever_correctly_implemented, x.intensity_correctly_achieved, x.uncertainty_successfully_induced, x.answer_constraint_satisfied) == (True, False, None, True)
    assert x.final_ground_truth_label == "REFUSE_GRANULARITY_MISMATCH" and x.line_no == 2**40 and x.generation_successful


def test_majority_contains_unanimous(spark):
    rows = None
    for i in range(12):
        given = [(v, 1, ("PASS", "FAIL", None, "PASS")[(i >> k) % 4]) for k, v in enumerate(vocab.VERIFIERS)]
        part = votes(spark, given, q=f"pq{i}")
        rows = part if rows is None else rows.union(part)
    a = V.align(rows)
    keys = lambda df: {r.content_key for r in df.collect()}
    assert keys(V.unanimous_filter(a)) <= keys(V.majority_filter(a))


def test_a_hot_content_is_one_group(spark):
    many = spark.range(20000).select(
        F.lit("gpt").alias("generator_model"), F.lit("claude").alias("verifier_model"), F.col("id").alias("line_no"), F.lit("q").alias("source_qid"),
        F.lit("p").alias("perturbed_query"), F.lit("c").alias("perturbed_context"), F.lit("P-Ambiguity").alias("perturbation_class"),
        F.lit("LOW").alias("intensity"), F.lit("l").alias("lever_selected"), F.lit(True).alias("verification_successful"),
        F.when(F.col("id") == 19999, "FAIL").otherwise("PASS").alias("verification_result"), F.lit(True).alias("generation_successful"),
    )
    assert one(V.align(many)).votes[0].result == "FAIL"


# --- sampling -----------------------------------------------------------------------------------


def pool(spark, sizes):
    rows = [(g, c, i, f"{g}{c}{i}{n}") for (g, c, i), size in sizes.items() for n in range(size)]
    return spark.createDataFrame(rows, "generator_model string, perturbation_class string, intensity string, content_key string")


def test_quota_fill_and_foreign_strata(spark):
    p = pool(spark, {("g", "P-Ambiguity", "LOW"): 50, ("g", "P-Ambiguity", "HIGH"): 3, ("g", "P-Odd", "LOW"): 40})
    s = S.stratified_ids(p, per_stratum=10, target=30).collect()
    by = {}
    for r in s:
        by[r.stratum] = by.get(r.stratum, 0) + 1
    assert len(s) == 30 and by["P-Ambiguity_LOW"] >= 10 and by["P-Ambiguity_HIGH"] == 3
    everything = S.stratified_ids(p, per_stratum=10, target=1000)
    assert everything.count() == 93
    none_left = S.stratified_ids(p, per_stratum=10, target=5)
    assert none_left.count() == 13  # the quota alone exceeds the target


def test_sample_does_not_depend_on_partitioning(spark):
    p = pool(spark, {("g", "P-Ambiguity", i): 200 for i in vocab.INTENSITIES})
    picks = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        picks.append(sorted(r.content_key for r in S.stratified_ids(p.repartition(n), per_stratum=20, target=100).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 100


def test_dedupe_and_merge(spark):
    old = spark.createDataFrame([("s1", "m", 1), ("s2", "m", 1)], "sample_id string, model_id string, v int")
    new = spark.createDataFrame([("s2", "m", 2), ("s3", "m", 2)], "sample_id string, model_id string, v int")
    assert {r.sample_id: r.v for r in S.merge_results(old, new).collect()} == {"s1": 1, "s2": 2, "s3": 2}


def test_unique_keys_are_unique_beyond_four_digits(spark):
    rows = spark.range(15000).select(
        F.lit("gpt-4o").alias("generator_model"), F.lit("q").alias("source_qid"), F.lit("P-Ambiguity").alias("perturbation_class"), F.lit("LOW").alias("intensity"),
        F.lit("pq").alias("perturbed_query"), F.lit("pc").alias("perturbed_context"), F.col("id").cast("string").alias("content_key"),
    )
    out = K.unique_key(rows)
    assert out.select("unique_id").distinct().count() == 15000
    assert out.filter("unique_id RLIKE '^RB_gpt_q_P-Ambiguity_LOW_[0-9a-f]{8}_[0-9]{4,}$'").count() == 15000


def test_unique_keys_move_no_texts(spark):
    """With and without repeated prefixes there is no exchange above the rows."""
    rows = spark.range(3000).select(
        F.lit("gpt-4o").alias("generator_model"), F.concat(F.lit("q"), F.col("id") % 2999).alias("source_qid"), F.lit("P-Ambiguity").alias("perturbation_class"),
        F.lit("LOW").alias("intensity"), F.lit("pq").alias("perturbed_query"), F.lit("pc").alias("perturbed_context"), F.col("id").cast("string").alias("content_key"),
    )
    for part, later in ((rows, 1), (rows.filter("id < 2999"), 0)):
        out = K.unique_key(part)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and ("BroadcastHashJoin" in plan) == bool(later)
        assert out.filter("unique_id LIKE '%_0002'").count() == later


# --- passages --------------------------------------------------------------------------------------


def nested(spark, correct, cited=None, texts=None):
    n = len(correct)
    row = ("s", "old question", [{f"cite_{i + 1}": (texts or [f"t{i}" for i in range(n)])[i]} for i in range(n)], correct, cited or ["NO"] * n, ["NO"] * n)
    return spark.createDataFrame([row], "sample_id string, question string, grounding array<map<string,string>>, evidence_correct array<string>, evidence_cited array<string>, evidence_relevant array<string>")


SIG, REL, OUT = vocab.SIGNAL_LABEL, vocab.RELATED_LABEL, "OUTDATED"


def test_surplus_signal_does_not_fill_missing_noise(spark):
    assert P.compose(nested(spark, [SIG] * 8 + [OUT]), total=4, signal=2).count() == 0
    kept = one(P.compose(nested(spark, [OUT, SIG, REL, SIG, OUT, SIG], ["NO", "NO", "NO", "YES", "YES", "NO"]), total=4, signal=2))
    assert [list(m.values())[0] for m in kept.grounding] == ["t1", "t2", "t3", "t4"]
    assert kept.curation_notes.normalization_strategy == "2_signal_2_noise"


def test_short_label_array_and_blank_passage(spark):
    df = nested(spark, [SIG, OUT, OUT], texts=["a", " \n ", "c"]).withColumn("evidence_correct", F.array(F.lit(SIG)))
    r = one(P.split_passages(df))
    assert (r.signal_indices, r.noise_indices, r.noise_passages) == ([0], [2], ["c"])


def patched(spark, signal, noise, parsed=True):
    df = P.split_passages(nested(spark, [SIG, OUT, SIG, OUT, OUT]))
    patches = "array<struct<original_index:int,perturbed_text:string>>"
    extra = spark.createDataFrame([("s", signal, noise, "new question", parsed)], f"sample_id string, signal_patches {patches}, noise_patches {patches}, perturbed_query string, parsing_successful boolean")
    return df.join(extra, "sample_id")


def test_patches_last_wins_out_of_range_ignored_and_undone(spark):
    df = patched(spark, [(1, "a"), (1, "b"), (9, "far")], [(None, "n0"), (-1, "last")])
    r = one(P.apply_patches(df))
    assert [list(m.values())[0] for m in r.grounding] == ["t0", "n0", "b", "t3", "last"]
    assert list(r.grounding[2]) == ["cite_3"] and r.question == "new question"
    back = one(P.restore(P.apply_patches(df)))
    assert back.question == "old question" and [list(m.values())[0] for m in back.grounding] == ["t0", "t1", "t2", "t3", "t4"]


def test_unparsed_reply_or_null_lists_change_nothing(spark):
    assert one(P.apply_patches(patched(spark, [(0, "x")], [], parsed=False))).question == "old question"
    r = one(P.apply_patches(patched(spark, None, None)))
    assert [list(m.values())[0] for m in r.grounding] == ["t0", "t1", "t2", "t3", "t4"]


def test_formatting_without_passages(spark):
    df = nested(spark, [SIG]).select(P.format_passages(F.array().cast("array<map<string,string>>")).alias("none"), P.format_passages(F.array(F.create_map(F.lit("url"), F.lit("u")))).alias("no_text"), P.list_passages(F.array().cast("array<string>"), "S").alias("listed"))
    r = one(df)
    assert (r.none, r.no_text, r.listed) == ("No search results provided.", "[1] No cite field found in passage 1", "  [None provided]")


# --- replies ------------------------------------------------------------------------------------------


def parsed(spark, reply):
    return one(R.parse_fenced_json(spark.createDataFrame([(reply,)], "response string"), "a string"))


@pytest.mark.parametrize("reply, value", [
    ('```json\n{"a": "1"}\n```', "1"),
    ('so: ```json {"a": "1"} ``` and ```json {"a": "2"} ```', "1"),
    ('```\n{"a": "1"}\n``` tail', "1"),
    (' {"a": "x"} \n', "x"),
    ('{"a": "}"}', "}"),
])
def test_readable_json(spark, reply, value):
    r = parsed(spark, reply)
    assert r.parsing_successful and r.parsed.a == value


@pytest.mark.parametrize("reply", [
    '```json\n{"a": "1"}', '[{"a": "1"}]', "{'a': '1'}", '{"a": "1"} trailing', '{"a": "1"} {"a": "2"}', '{"a": "1"}, {"a": "2"}', "", "plain", '"text"', '{"a": ',
])
def test_unreadable_json(spark, reply):
    r = parsed(spark, reply)
    assert not r.parsing_successful and r.parsed is None and r.parsing_error and r.raw_response is not None


def judged(spark, reply):
    return one(R.parse_judgement(spark.createDataFrame([(reply,)], "response string")))


@pytest.mark.parametrize("reply, kind, score", [
    ("CLASSIFICATION: answer_attempt\nQUALITY_SCORE: 4\nEXPLANATION: ok", "answer_attempt", 4.0),
    ("  \n CLASSIFICATION: answer_attempt \r\nQUALITY_SCORE: 4.5", "answer_attempt", 4.5),
    ("CLASSIFICATION: REFUSE_OTHER\nQUALITY_SCORE: N/A", "REFUSE_OTHER", None),
    ("CLASSIFICATION: REFUSE_OTHER\nQUALITY_SCORE: n/a", "REFUSE_OTHER", None),
    ("CLASSIFICATION: answer_attempt\nQUALITY_SCORE: 4d", "answer_attempt", None),
    ("CLASSIFICATION: REFUSE_OTHER", "REFUSE_OTHER", None),
    ("refuse_other or refuse_ambiguous_query", "REFUSE_AMBIGUOUS_QUERY", None),
    ("nothing", "answer_attempt", None),
    ("x\n CLASSIFICATION: REFUSE_OTHER\nQUALITY_SCORE: 3", "REFUSE_OTHER", None),
])
def test_judgement_lines(spark, reply, kind, score):
    r = judged(spark, reply)
    assert (r.model_predicted_type, r.judge_quality_score) == (kind, score)


def test_comprehensive_scores(spark):
    rows = [(True, "ANSWER_CORRECTLY", "CLASSIFICATION: answer_attempt\nELIGIBILITY: 1\nFACTUALITY_ALL: N/A\nFACTUALITY_RELEVANT: yes"),
            (True, "ANSWER_CORRECTLY", "CLASSIFICATION: REFUSE_OTHER\nELIGIBILITY: 1"),
            (False, "REFUSE_OTHER", "CLASSIFICATION: REFUSE_OTHER\nREFUSAL_APPROPRIATENESS: 0"),
            (False, "REFUSE_OTHER", "no lines")]
    out = R.parse_comprehensive(spark.createDataFrame(rows, "is_answerable boolean, expected_behavior string, response string").coalesce(1)).collect()
    assert [(r.eligibility, r.factuality_all, r.factuality_relevant, r.refusal_appropriateness) for r in out] == [(1, None, 0, None), (0, 0, 0, None), (None, None, None, 1), (None, None, None, 0)]


def test_reply_keys_override_ours(spark):
    asked = spark.createDataFrame([("r1", "P-Ambiguity", "LOW", '{"perturbed_query": "x", "intensity": "HIGH"}', None, False)], "request_id string, perturbation_class string, intensity string, response string, error string, pending boolean")
    r = one(R.generation_result(asked, "perturbed_query string, intensity string"))
    assert (r.perturbation_class, r.intensity, r.perturbed_query, r.generation_successful) == ("P-Ambiguity", "HIGH", "x", True)


# --- work lists, labels, keys ---------------------------------------------------------------------------


def test_resume_twice_is_resume_once(spark):
    samples = spark.createDataFrame([("s1",), ("s2",)], "sample_id string")
    done = spark.createDataFrame([("s1", "a"), ("s1", "a"), ("s2", "zzz")], "sample_id string, model_id string")
    left = J.remaining(samples, done, ["a", "b"])
    assert sorted((r.sample_id, r.model_id) for r in left.collect()) == [("s1", "b"), ("s2", "a"), ("s2", "b")]
    assert J.remaining(samples, done.unionByName(left.select("sample_id", "model_id")), ["a", "b"]).count() == 0


def test_cells_done_twice_leave_an_instance_open_but_without_work(spark):
    rows = [("q1", c, i, True) for c, i in vocab.CELLS] + [("q1", *vocab.CELLS[0], True)] + [("q2", c, i, (c, i) != vocab.CELLS[3]) for c, i in vocab.CELLS]
    done = spark.createDataFrame(rows, "source_qid string, perturbation_class string, intensity string, generation_successful boolean")
    ins = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3")], "line_no bigint, qid string")
    assert {r.source_qid: r.is_complete for r in J.finished_cells(done).collect()} == {"q1": False, "q2": False}
    out = J.missing_cells(ins, done).collect()
    assert [(r.qid, r.perturbation_class, r.intensity) for r in out if r.qid == "q2"] == [("q2", *vocab.CELLS[3])]
    assert sum(r.qid == "q3" for r in out) == 18 and not any(r.qid == "q1" for r in out)
    assert {r.qid for r in J.missing_cells(ins, done, target=1).collect()} == {"q2"}


def test_unknown_cell_is_flagged_not_raised(spark):
    df = spark.createDataFrame([("P-Ambiguity", "LOW"), ("P-Nope", "LOW"), (None, None)], "perturbation_class string, intensity string")
    out = {r.perturbation_class: r for r in C.with_levers(df).collect()}
    assert out["P-Ambiguity"].cell_error is None and out["P-Ambiguity"].levers == 10 and out["P-Nope"].cell_error
    assert {r.perturbation_class: r.known_class for r in RC.ground_truth(df).collect()} == {"P-Ambiguity": True, "P-Nope": False, None: False}


def test_catalogue_has_176_levers_in_18_cells(spark):
    levers = C.catalogue(spark)
    assert levers.count() == 176 and levers.select("perturbation_class", "intensity").distinct().count() == 18
    assert levers.filter("length(instruction) < 10 OR length(illustration) < 5").count() == 0


def test_null_and_empty_keys_are_the_same(spark):
    df = spark.createDataFrame([(None, "x"), ("", "x")], "a string, b string")
    assert df.select(K.content_key(["a", "b"]).alias("k")).distinct().count() == 1


def test_bare_string_answer_and_display(spark):
    df = spark.createDataFrame([("yes",)], "answer string")
    assert one(df.select(T.answer_display(RC.as_answers(df)).alias("t"))).t == '"yes"'


def test_originals_last_wins_and_empty_qid_is_dropped(spark):
    orig = spark.createDataFrame([("q1", "old", ["a", "b"], 1), ("q1", "new", ["a", "c"], 2), ("", "none", ["z"], 3)], "qid string, answer string, retrieved_docs array<string>, line_no bigint")
    rows = spark.createDataFrame([("q1", "P"), ("q2", "P"), ("", "P")], "source_qid string, perturbed_context string")
    out = {r.source_qid: r for r in UN.join_original(rows, orig).collect()}
    assert out["q1"].answer == "new" and out["q1"].retrieved_docs == ["P", "c"]
    assert not out["q2"].has_original and not out[""].has_original


def test_judge_requests_follow_answers_that_arrived(spark):
    from demur.plans import evaluation

    samples = spark.createDataFrame([("s1", "q1", "c", "ANSWER_CORRECTLY", ["yes"]), ("s2", "q2", "c", "REFUSE_OTHER", ["no"])], "sample_id string, query string, context string, ground_truth_label string, references array<string>")
    answers = spark.createDataFrame([("s1", "m", "it is yes", None), ("s2", "m", "hm", None), ("s2", "n", None, "timeout")], "sample_id string, model_id string, response string, error string")
    out = {(r.sample_id, r.model_id): r for r in evaluation.next_judgements(samples, answers).collect()}
    assert set(out) == {("s1", "m"), ("s2", "m")}
    assert out["s1", "m"].branch == "references" and "yes" in out["s1", "m"].prompt
    assert out["s2", "m"].branch == "no_references" and T.NO_REFERENCE in out["s2", "m"].prompt


def test_multidoc_results_feed_the_single_document_tables(spark):
    rows = spark.createDataFrame([("m", RA, RA, True, "HIGH"), ("m", RA, RO, False, "HIGH")], "model_id string, expected_behavior string, refusal_classification string, refusal_match_correct boolean, intensity string").withColumn("answer_quality_score", F.lit(None).cast("double"))
    assert one(M.refusal_by_class(MD.as_single(rows))).refusal_accuracy == 0.5


def test_votes_without_line_numbers_are_refused(spark):
    v = votes(spark, [(n, 1, "PASS") for n in vocab.VERIFIERS]).withColumn("line_no", F.lit(None).cast("bigint"))
    with pytest.raises(Exception, match="votes need line_no"):
        V.align(v).collect()


def test_generator_prompt_has_the_whole_menu_and_the_reply_keys(spark):
    ins = spark.createDataFrame([(1, "q1", "what?", "a text", ["yes", "no"])], "line_no bigint, qid string, query string, context string, answers array<string>")
    out = T.generator_requests(ins).collect()
    assert len(out) == 18 and len({r.request_id for r in out}) == 18
    menu = {(c, i): 0 for c, i in vocab.CELLS}
    for r in C.catalogue(spark).collect():
        menu[r.perturbation_class, r.intensity] += 1
    for r in out:
        assert "QUESTION: what?" in r.prompt and "CONTEXT: a text" in r.prompt
        assert r.prompt.count(". **") == menu[r.perturbation_class, r.intensity]
        assert all(f'"{k}"' in r.prompt for k in vocab.GENERATOR_KEYS) and '"yes" OR "no"' in r.prompt
