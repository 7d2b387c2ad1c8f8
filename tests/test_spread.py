"""Work is dealt out before rows multiply; computed tables are not gathered on the driver."""

import pytest
from pyspark.sql import functions as F

from checks import fixtures
from checks.io_queries import MERGED_SCHEMA
from checks.prompt_queries import occurrences
from demur.operators import matching as J
from demur.operators import prompts as T
from demur.operators import unified as UN
from demur.operators import voting as V
from demur.plans import datasets, shared
from demur.sources import tables as TB
from demur.streaming import results as R

VOTE = """generator_model string, verifier_model string, line_no bigint, source_qid string, original_query string, original_context string, perturbed_query string,
    perturbed_context string, perturbation_class string, intensity string, lever_selected string, verification_successful boolean, verification_result string, generation_successful boolean"""


def votes(spark, n=6):
    rows = [
        ("gpt", v, k, f"q{k}", "what?", "c", f"pq {k}", "pc", "P-Ambiguity", "LOW", "l", True, "PASS", True)
        for k in range(n) for v in ("claude", "nova", "gpt", "deepseek")
    ]
    return spark.createDataFrame(rows, VOTE)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_small_file_is_dealt_out_before_its_rows_multiply(spark, tmp_path, monkeypatch):
    spark.range(1000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    text = "SELECT p_partkey, g, v FROM @part@ @range 4 AS g@ @range 4 AS v@"
    whole = fixtures.on_spark(spark, str(tmp_path), text)
    assert whole.rdd.getNumPartitions() == 1
    monkeypatch.setattr(fixtures, "SPREAD_BYTES", 10_000)
    dealt = fixtures.on_spark(spark, str(tmp_path), text)
    assert dealt.rdd.getNumPartitions() > 4 and "RoundRobinPartitioning" in plan(dealt)
    assert sorted(dealt.collect()) == sorted(whole.collect()) and dealt.count() == 16_000


def test_computed_tables_are_not_broadcast_by_an_estimate(spark):
    v = votes(spark)
    aligned = V.align(v)
    replies = spark.createDataFrame([("a", "new", None, 2)], "request_id string, response string, error string, seq int")
    originals = spark.createDataFrame([("q1", ["x"], 1)], "qid string, retrieved_docs array<string>, line_no bigint")
    for df in (
        V.base_verification(v, aligned), J.attach(spark.createDataFrame([("a",)], "request_id string"), replies),
        UN.join_original(v.drop("line_no"), originals), J.remaining(v.withColumnRenamed("source_qid", "sample_id"), spark.createDataFrame([("q1", "m")], "sample_id string, model_id string"), ["m"]),
    ):
        assert "BroadcastHashJoin" not in plan(df) and "SortMergeJoin" in plan(df)
    assert V.base_verification(v, aligned).count() == 6


def test_written_and_few_contents_are_still_sent_to_the_texts(spark, tmp_path, monkeypatch):
    v = votes(spark)
    kept = shared.materialise(V.align(v), "kept", str(tmp_path))
    assert "BroadcastHashJoin" in plan(V.base_verification(v, kept))
    monkeypatch.setattr(shared, "FEW", 3)
    assert shared.join_way(kept, 3) == "merge" and shared.join_way(kept, 6) == "broadcast"


def test_filtered_votes_meet_in_a_shuffle(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(datasets.sinks, "write_by_pair", lambda df, path: seen.append(plan(df)))
    datasets.write_filtered_votes(votes(spark), V.align(votes(spark)), str(tmp_path))
    assert "BroadcastHashJoin" not in seen[0] and "SortMergeJoin" in seen[0]


@pytest.mark.parametrize("done", [2, 5])
def test_keys_of_a_log_meet_in_a_shuffle(spark, monkeypatch, done):
    v, plans = votes(spark), []
    write = J.materialise
    monkeypatch.setattr(J, "materialise", lambda df, name: plans.append(plan(df)) or write(df, name))
    left = J.remaining_verifications(v, v.filter(F.col("line_no") < done))
    assert "BroadcastHashJoin" not in plans[0] and left.count() == 4 * (6 - done)


def after(text: str, first: str, then: str) -> bool:
    """In a plan, which shows the last step first."""
    return text.index(first) < text.rindex(then)


def test_passages_are_listed_once_per_instance(spark):
    rows = spark.createDataFrame([("q", 1, "what?", "a", ["s1"], ["n1", "n2"])], "qid string, line_no bigint, question string, answer_generate string, signal_passages array<string>, noise_passages array<string>")
    out = T.generator_requests(rows, "multi")
    logical = out._jdf.queryExecution().optimizedPlan().toString()
    assert after(logical, "Generate inline", "Passage S") and "Passage S" not in logical[: logical.index("Generate inline")]
    prompts = {r.perturbation_class: r.prompt for r in out.collect()}
    assert len(prompts) == 6 and all("n2" in p and "REFERENCE ANSWER: a" in p for p in prompts.values())
    assert (T.AMBIGUITY_NOTE in prompts["P-Ambiguity"]) and T.AMBIGUITY_NOTE not in prompts["P-MissingInfo"]


def test_a_verification_prompt_is_made_once_per_rewrite(spark):
    out = T.verifier_requests(votes(spark).drop("verifier_model"), ("claude", "nova"))
    logical = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Check the rewrite below" not in logical[: logical.index("Generate explode")]
    assert out.count() == 2 * 24 and out.select("prompt").distinct().count() == 6


def test_merging_shuffles_rows_once(spark, tmp_path, monkeypatch):
    schema = MERGED_SCHEMA
    monkeypatch.setattr(TB, "PART_ROWS", 3)
    seen = []
    combined = R._last_wins

    def watched(keys, seq):
        combine = combined(keys, seq)

        def each(old, batch, number):
            out = combine(old, batch, number)
            seen.append(plan(out).split("== Initial Plan ==")[0].count("Exchange "))
            return out

        return each

    monkeypatch.setattr(R, "_last_wins", watched)
    path = str(tmp_path / "t")

    def row(sample, kind, seq):
        return (sample, "m", "REFUSE_OTHER", "P-Ambiguity", "LOW", kind, None, True, seq)

    first = [row(f"s{k}", "A", 1) for k in range(40)] + [row("s0", "B", 2), row(None, "C", 1)]
    again = [row("s1", "D", 5), row("s1", "E", 7), row("s99", "F", 1), row(None, "G", 1)]
    assert R.merge_results(spark.createDataFrame(first, schema), path, "a", 0, buckets=4)
    assert R.merge_results(spark.createDataFrame(again, schema), path, "a", 1, buckets=4)
    assert not R.merge_results(spark.createDataFrame(again, schema), path, "a", 1, buckets=4)
    got = {r.sample_id: r.model_predicted_type for r in TB.read_merged(spark, path).collect()}
    assert got == {**{f"s{k}": "A" for k in range(40)}, "s0": "B", "s1": "E", "s99": "F", None: "G"}
    assert sum(r.n for r in R.status(spark, path).collect()) == 42 and seen == [1, 1]


def test_merged_rows_are_written_small(spark, tmp_path):
    votes_path, results_path = str(tmp_path / "v"), str(tmp_path / "r")
    assert R.merge_votes(votes(spark), votes_path, "a", 0, buckets=2)
    rows = [(f"s{k}", "m", "REFUSE_OTHER", "P-Ambiguity", "LOW", "A", None, True, k) for k in range(20)]
    assert R.merge_results(spark.createDataFrame(rows, MERGED_SCHEMA), results_path, "a", 0, buckets=2)
    for path in (votes_path, results_path):
        files = [f.name for f in (tmp_path / path).glob(f"{TB.DATA}/**/*.parquet")]
        assert files and all(f.endswith(".zstd.parquet") for f in files)
    assert R.aligned(spark, votes_path).count() == 6 and TB.read_merged(spark, results_path).count() == 20


ASKED = "qid string, line_no bigint, question string, answer_generate string, signal_passages array<string>, noise_passages array<string>"


def test_cell_texts_are_put_together_once_per_cell(spark):
    rows = spark.createDataFrame([("q", 1, "what?", "a", ["s1"], [])], ASKED)
    logical = T.generator_requests(rows, "multi")._jdf.queryExecution().optimizedPlan().toString()
    per_row = logical[: logical.index("Join Inner")]
    assert "concat_ws" in per_row and not any(text in per_row for text in ("Rewrite the material", "STRATEGY", "Reply with one JSON object"))
    bare = T.default_wording(spark).withColumn("strategy", F.lit(None).cast("string"))
    prompts = {r.perturbation_class: r.prompt for r in T.generator_requests(rows, "multi", wording=bare).collect()}
    before = "NOISE PASSAGES:\n  [None provided]\n"
    assert f"{before}CONSTRAINT: " in prompts["P-MissingInfo"] and f"{before}{T.AMBIGUITY_NOTE}\nCONSTRAINT: " in prompts["P-Ambiguity"]


def test_occurrences_are_counted_in_one_search(spark):
    rows = spark.createDataFrame([("  Passage S1: ä.\n  Passage N1: b.\n  Passage N2: Passage S", ". ** x. **"), ("none", "..**"), (None, None)], "prompt string, menu string")
    out = rows.select(occurrences("prompt", "  Passage S", "  Passage N").alias("passages"), occurrences("menu", ". **").alias("entries"))
    assert out.dtypes == [("passages", "bigint"), ("entries", "bigint")]
    assert [tuple(r) for r in out.collect()] == [(3, 2), (0, 0), (None, None)]
    logical = out._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(" not in logical and logical.count("regexp_extract_all(prompt") + logical.count("regexp_count(prompt") == 1
