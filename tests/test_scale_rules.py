"""No caps, prefixes or thresholds; shared storage; one reply per request."""

import pytest
from pyspark.sql import functions as F

from demur.functions import keys as K
from demur.operators import matching as J
from demur.operators import records as RC
from demur.operators import sampling as S
from demur.operators import unified as UN
from demur.plans import shared
from demur.sources import readers as RD
from demur.sources import sinks as SK
from demur.streaming import logs as L

REWRITE = "generator_model string, source_qid string, original_query string, original_context string, perturbation_class string, intensity string, lever_selected string, perturbed_query string, perturbed_context string"


def rewrites(spark, contexts):
    return spark.createDataFrame([("gpt", "q", "what?", c, "P-Ambiguity", "LOW", "l", "pq", "pc") for c in contexts], REWRITE)


def test_resume_looks_at_whole_contexts(spark):
    long = "x" * 5000
    both, done = rewrites(spark, [long + "a", long + "b"]), rewrites(spark, [long + "a"])
    assert [r.original_context[-1] for r in J.remaining_verifications(both, done).collect()] == ["b"]
    assert J.remaining_verifications(both, done, prefix=100).count() == 0  # the older key takes them for one
    other = both.withColumn("lever_selected", F.lit("another"))
    assert J.remaining_verifications(other, both).count() == 2


def test_tasks_look_at_whole_contexts(spark):
    rows = rewrites(spark, ["x" * 300 + "a", "x" * 300 + "b"])
    assert rows.select(K.task_key().alias("k")).distinct().count() == 2
    assert rows.select(K.task_key(200).alias("k")).distinct().count() == 1


def test_separators_in_texts_do_not_join_contents(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "a string, b string")
    assert rows.select(K.content_key(["a", "b"]).alias("k")).distinct().count() == 2


def test_all_instances_by_default(spark):
    rows = spark.range(250).select(
        F.col("id").alias("line_no"), F.col("id").cast("string").alias("qid"), F.lit("q").alias("query"), F.lit("a").alias("answer"),
        F.array(F.lit("context")).alias("gold_docs"), F.array().cast("array<string>").alias("retrieved_docs"),
    )
    assert RC.base_instances(rows).count() == 250
    assert RC.base_instances(rows, 100).count() == 100


@pytest.mark.parametrize("n", [0, 1, 7, 999, 1001, 5000])
def test_first_n_for_any_n(spark, n):
    rows = spark.range(4000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("content_key")).withColumn("_h", F.md5("content_key"))
    rows = rows.withColumn("_h", F.when(F.col("g") == 2, F.lit("0" * 32)).otherwise(F.col("_h")))  # one group of ties
    got = {(r.g, r.content_key) for r in S.first_n(rows, ["g"], n).collect()}
    want = set()
    for g in range(3):
        own = sorted((r["_h"], r.content_key) for r in rows.filter(F.col("g") == g).collect())
        want |= {(g, k) for _, k in own[:n]}
    assert got == want


def test_one_reply_for_each_request(spark):
    requests = spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string")
    replies = spark.createDataFrame(
        [("a", "old", None, 1), ("a", "new", None, 2), ("a", None, "timeout", 3), ("b", None, "e1", 1), ("b", None, "e2", 2)],
        "request_id string, response string, error string, seq int",
    )
    rows = {r.request_id: (r.response, r.error, r.pending) for r in J.attach(requests, replies).collect()}
    assert rows == {"a": ("new", None, False), "b": (None, "e2", False), "c": (None, None, True)}


def test_results_need_their_key_column(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    with open(path, "w") as f:
        f.write("query,model_predicted_type\nq?,ERROR\n")
    with pytest.raises(ValueError, match="model_id"):
        RD.read_results(spark, path).collect()


def test_numbering_lines_shuffles_no_text(spark, tmp_path):
    SK.write_jsonl(spark.range(1000).select(F.col("id").alias("n"), F.lit("text").alias("t")).repartition(4), str(tmp_path / "log"))
    df = RD.read_jsonl(spark, str(tmp_path / "log"), "n bigint, t string", numbered=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("_block" in line for line in exchanges)  # of the counts per split
    assert sorted(r.line_no for r in df.collect()) == list(range(1, 1001))


def test_a_hot_question_can_be_split(spark):
    """Both sides of the join come straight from a shuffle, as splitting a skewed join needs."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 != 0, "q1").otherwise(F.concat(F.lit("q"), F.col("id"))).alias("source_qid"), F.repeat(F.col("id").cast("string"), 20).alias("perturbed_context"))
    originals = spark.createDataFrame([("q1", ["x"], 1), ("q1", ["y"], 2)], "qid string, retrieved_docs array<string>, line_no bigint")
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        out = UN.join_original(rows.repartition(8), originals)
        assert out.filter("has_original").count() == 18_000
        out.collect()
        final = out._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in final and "skew=true" in final.replace("isSkew", "skew")
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_shared_folder(spark, tmp_path):
    assert shared.shared_path(spark, "x", str(tmp_path)).startswith(str(tmp_path))
    assert [shared.is_local(m) for m in ("local", "local[4]", "local-cluster[2,1,1024]", "spark://host:7077", "yarn")] == [True, True, False, False, False]
    written = shared.materialise(spark.range(5), "five", str(tmp_path))
    assert written.count() == 5
    shared.discard(written)
    assert not list(tmp_path.glob("demur-five-*"))


def test_progress_keeps_the_last_complete_version(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "sample_id string, model_id string, model_predicted_type string"
    assert L.progress(spark, target).count() == 0
    for k, n in enumerate((1, 1, 3)):
        SK.write_jsonl(spark.range(n).select(F.col("id").cast("string").alias("sample_id"), F.lit("m").alias("model_id"), F.lit("x").alias("model_predicted_type")), f"{source}/{k}")
        L.stream_progress(spark, source, schema, target, checkpoint).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out").glob("version=*")) == ["version=1", "version=2"]
    (tmp_path / "out" / "version=99").mkdir()  # begun and never finished
    assert [(r.model_id, r.status, r.n) for r in L.progress(spark, target).collect()] == [("m", "finished", 5)]


@pytest.mark.parametrize("limit", [500_000, 0])
@pytest.mark.parametrize("done", [range(0, 3), range(0, 37)])
def test_resuming_exchanges_no_rewrite(spark, monkeypatch, limit, done):
    """Few finished keys or few unfinished ones are broadcast; only many of both meet in a shuffle."""
    both = rewrites(spark, [f"context {k}" for k in range(40)])
    monkeypatch.setattr(J, "MAX_KEYS", limit)
    log = rewrites(spark, [f"context {k}" for k in done]).withColumn("verifier_model", F.lit("nova"))
    left = J.remaining_verifications(both, log)
    if limit:
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert {r.original_context for r in left.collect()} == {f"context {k}" for k in range(40) if k not in done}
    pending = {r.original_context: sorted(r.pending) for r in J.remaining_by_verifier(both, log, ["nova", "gpt"]).collect()}
    assert pending == {f"context {k}": ["gpt"] if k in done else ["gpt", "nova"] for k in range(40)}


def test_stamped_between_start_and_end(spark):
    start, end = (spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")") for _ in range(2))
    first = start.first()[0]
    stamped = {r.formatted_timestamp for r in UN.stamp(spark.range(3)).collect()}
    assert len(stamped) == 1 and first <= stamped.pop() <= end.first()[0]
