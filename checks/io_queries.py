"""Checked queries that write to a scratch folder, read back and compare with the source."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from checks.registry import Data, query
from checks.vote_queries import G, W
from demur.functions.columns import col
from demur.operators import metrics as M
from demur.operators import sampling as S
from demur.operators import voting as V
from demur.sources import readers as RD
from demur.sources import sinks as SK
from demur.sources import tables as TB
from demur.streaming import logs as L
from demur.streaming import replies as RP
from demur.streaming import results as R

VOTE_SCHEMA = "line_no bigint, source_qid string, original_query string, verification_successful boolean, verification_result string"


def lines(d: Data):
    """Votes as JSON text; every thirteenth line is cut off in the middle."""
    text = F.to_json(F.struct("line_no", "source_qid", "original_query", "verification_successful", "verification_result", "generator_model", "verifier_model"))
    return d.votes().select(F.when(col("line_no") % 13 == 0, F.substring(text, 1, 25)).otherwise(text).alias("value"))


@query("read_jsonl", "SELECT line_no, source_qid, original_query, verification_successful, verification_result FROM verifications WHERE line_no % 13 <> 0")
def _(d: Data):
    path = d.scratch()
    lines(d).write.text(path)
    return RD.read_jsonl(d.spark, path, VOTE_SCHEMA)


@query("count_bad_lines", "SELECT CAST(count(*) FILTER (WHERE line_no % 13 <> 0) AS BIGINT) AS good_lines, CAST(count(*) FILTER (WHERE line_no % 13 = 0) AS BIGINT) AS bad_lines FROM verifications")
def _(d: Data):
    path = d.scratch()
    lines(d).write.text(path)
    return RD.count_bad_lines(d.spark, path, VOTE_SCHEMA).agg(F.sum("good_lines").alias("good_lines"), F.sum("bad_lines").alias("bad_lines"))


@query("number_lines", "SELECT original_query, max(line_no) AS inside FROM verifications GROUP BY original_query")
def _(d: Data):
    """The last line by position is the one with the highest number inside the record."""
    path = d.scratch()
    d.votes().orderBy("line_no").select("original_query", col("line_no").alias("inside")).write.json(path)
    back = RD.read_jsonl(d.spark, path, "original_query string, inside bigint", numbered=True)
    return S.dedupe_last(back, ["original_query"], "line_no").select("original_query", "inside")


@query("read_verifications", """SELECT generator_model, verifier_model, line_no, source_qid, original_query, perturbed_query, perturbed_context, perturbation_class, intensity, lever_selected,
  verification_successful, verification_result, lever_correctly_implemented FROM verifications""")
def _(d: Data):
    root = d.scratch()
    flat = ("verification_result", "lever_correctly_implemented", "intensity_correctly_achieved", "uncertainty_successfully_induced")
    votes = d.votes()
    nested = votes.select(
        *[c for c in votes.columns if c not in (*flat, "verifier_ord", "generator_model", "verifier_model")],
        F.when(col("verification_successful"), F.struct(*flat)).alias("verification_response"), "generator_model", "verifier_model",
    )
    for g in ("claude", "deepseek", "gpt", "nova"):
        for v in ("claude", "nova", "gpt", "deepseek"):
            part = nested.filter((col("generator_model") == g) & (col("verifier_model") == v)).drop("generator_model", "verifier_model")
            part.write.json(f"{root}/dataset_{g}/log_verifications_{v}.jsonl")
    return RD.read_verifications(d.spark, root, numbered=False).select(
        "generator_model", "verifier_model", "line_no", "source_qid", "original_query", "perturbed_query", "perturbed_context", "perturbation_class",
        "intensity", "lever_selected", "verification_successful", "verification_result", "lever_correctly_implemented",
    )


RESULT_COLUMNS = "model_id, k AS entry_idx, generator_model, perturbation_class, intensity, ground_truth_label, model_predicted_type, answer_quality_score, refusal_match_correct"


@query("read_results", f"""SELECT {RESULT_COLUMNS}, 'said "no",' || chr(10) || 'then ' || sample_id AS model_raw_output FROM eval_results""")
def _(d: Data):
    path = d.scratch()
    texts = F.concat(F.lit('said "no",\nthen '), "sample_id")
    rows = d.results().select(
        "model_id", col("k").alias("entry_idx"), F.lit("u").alias("unique_id"), "generator_model", "perturbation_class", "intensity",
        F.lit("q").alias("query"), "ground_truth_label", F.lit(None).cast("string").alias("ground_truth_answer"), texts.alias("model_raw_output"),
        "model_predicted_type", "answer_quality_score", "refusal_match_correct", F.lit("why").alias("llm_evaluation_explanation"),
    )
    SK.write_csv(rows, path)
    return RD.read_results(d.spark, path).select(
        "model_id", "entry_idx", "generator_model", "perturbation_class", "intensity", "ground_truth_label", "model_predicted_type",
        "answer_quality_score", "refusal_match_correct", "model_raw_output",
    )


@query("read_results_layouts", "SELECT model_id, sample_id AS query, ground_truth_label, model_predicted_type, answer_quality_score FROM eval_results")
def _(d: Data):
    """Two CSV layouts in one folder and a Parquet folder without a suffix, read by name."""
    path = d.scratch()
    rows = d.results().select(
        col("sample_id").alias("query"), "model_predicted_type", "answer_quality_score", "ground_truth_label", "model_id", F.lit("x").alias("something_else"), "k"
    )
    older = rows.filter("k % 3 = 0").select("model_id", "query", "ground_truth_label", "model_predicted_type", "answer_quality_score")
    SK.write_csv(older, f"{path}/csv")
    SK.write_csv(rows.filter("k % 3 = 1").drop("k"), f"{path}/csv", mode="append")
    SK.append_results(rows.filter("k % 3 = 2"), f"{path}/results")
    back = RD.read_results(d.spark, f"{path}/csv").unionByName(RD.read_results(d.spark, f"{path}/results"))
    return back.select("model_id", "query", "ground_truth_label", "model_predicted_type", "answer_quality_score")


@query("read_verifications_parts", """SELECT generator_model, verifier_model, count(*) AS n, count(DISTINCT line_no) AS lines, CAST(max(line_no) AS BIGINT) AS last FROM (
  SELECT generator_model, verifier_model, row_number() OVER (PARTITION BY generator_model, verifier_model ORDER BY line_no) AS line_no FROM verifications) GROUP BY ALL""")
def _(d: Data):
    """Every log is a folder of several part files; lines are numbered over all of them."""
    root = d.scratch()
    votes = d.votes()
    for g in ("claude", "deepseek", "gpt", "nova"):
        for v in ("claude", "nova", "gpt", "deepseek"):
            part = votes.filter((col("generator_model") == g) & (col("verifier_model") == v)).select("source_qid", "original_query", "perturbed_query", "verification_successful")
            part.repartition(3).write.json(f"{root}/dataset_{g}/log_verifications_{v}.jsonl")
    back = RD.read_verifications(d.spark, root)
    return back.groupBy("generator_model", "verifier_model").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("line_no").alias("lines"), F.max("line_no").alias("last")
    )


@query("write_jsonl", "SELECT line_no, qid, query, md5(gold_doc) AS gold_doc FROM base_instances")
def _(d: Data):
    path = d.scratch()
    SK.write_jsonl(d.fixture("base_instances"), path)
    back = RD.read_jsonl(d.spark, path, "line_no bigint, qid string, query string, gold_doc string")
    return back.withColumn("gold_doc", F.md5("gold_doc"))


@query("write_by_pair", "SELECT generator_model, verifier_model, count(*) AS n, CAST(sum(line_no) AS BIGINT) AS lines FROM verifications WHERE generator_model <> 'gpt' OR verifier_model = 'nova' GROUP BY ALL")
def _(d: Data):
    path = d.scratch()
    SK.write_by_pair(d.votes().filter("generator_model <> 'gpt' OR verifier_model = 'nova'"), path)
    back = d.spark.read.schema("line_no bigint, generator_model string, verifier_model string").json(path)
    return back.groupBy("generator_model", "verifier_model").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("lines"))


@query("write_csv_tables", "SELECT model_id, ground_truth_label, model_predicted_type, count(*) AS n FROM eval_results WHERE ground_truth_label <> 'ANSWER_CORRECTLY' GROUP BY ALL")
def _(d: Data):
    path = d.scratch()
    SK.write_csv(M.confusion_matrix(d.results()), path)
    return d.spark.read.schema("model_id string, ground_truth_label string, model_predicted_type string, n bigint").option("header", True).csv(path)


@query("append_results", "SELECT model_id, sample_id AS query, model_predicted_type FROM eval_results")
def _(d: Data):
    """Batches that a restarted job appends again, read back while one more has been written but not committed."""
    path = d.scratch()
    rows = d.results().select("model_id", col("sample_id").alias("query"), "model_predicted_type")
    for name, part in (("a", rows.filter("model_id < 'model_2'")), ("b", rows.filter("model_id >= 'model_2'")), ("a", rows), ("b", rows)):
        SK.append_results(part, path, batch=name)
    rows.limit(10).write.parquet(f"{path}/{TB.DATA}/never-committed")
    return RD.read_results(d.spark, path).select("model_id", "query", "model_predicted_type")


# --- streaming: two drops of files, each followed by a run; the result is the batch result ------


def _drops(d: Data, first, second, run):
    base = d.scratch()
    source, target, checkpoint = f"{base}/in", f"{base}/out", f"{base}/checkpoint"
    for i, part in enumerate((first, second)):
        SK.write_jsonl(part, f"{source}/drop{i}")
        run(source, target, checkpoint).awaitTermination()
    return target


@query("stream_verification_log", "SELECT line_no, source_qid, original_query, verification_successful, verification_result FROM verifications")
def _(d: Data):
    v = d.votes()
    target = _drops(
        d, v.filter("line_no % 2 = 0"), v.filter("line_no % 2 = 1"),
        lambda s, t, c: L.stream_verification_log(d.spark, s, VOTE_SCHEMA, t, c),
    )
    return d.spark.read.parquet(target)


RESULT_SCHEMA = "sample_id string, model_id string, model_predicted_type string, seq bigint"


UPSERTED = """SELECT k, sample_id, model_id, ground_truth_label, perturbation_class, intensity,
  CASE WHEN k % 4 = 0 THEN 'REDO' ELSE model_predicted_type END AS model_predicted_type, answer_quality_score, refusal_match_correct FROM eval_results"""
MERGED_SCHEMA = """sample_id string, model_id string, ground_truth_label string, perturbation_class string, intensity string,
    model_predicted_type string, answer_quality_score double, refusal_match_correct boolean, seq bigint"""


def merged_results(d: Data) -> str:
    """Two drops of result files merged by a stream that crashes once after writing the second one's data."""
    r = d.results().withColumn("seq", col("k")).select(*[f.split()[0] for f in MERGED_SCHEMA.split(",")])
    base = d.scratch()
    source, target, checkpoint = f"{base}/in", f"{base}/out", f"{base}/checkpoint"

    def run() -> None:
        R.stream_results(d.spark, source, MERGED_SCHEMA, target, checkpoint, buckets=8).awaitTermination()

    SK.write_jsonl(r, f"{source}/0", compression="gzip")
    run()
    SK.write_jsonl(r.filter("seq % 4 = 0").withColumn("model_predicted_type", F.lit("REDO")), f"{source}/1", compression="gzip")
    publish = TB.publish
    TB.publish = _gone
    try:
        run()
    except StreamingQueryException:
        pass
    finally:
        TB.publish = publish
    run()
    return target


def _gone(*_):
    raise OSError("the writer is lost before the version is published")


@query("stream_dedupe_upsert", f"SELECT sample_id, model_id, model_predicted_type FROM ({UPSERTED})")
def _(d: Data):
    return TB.read_merged(d.spark, merged_results(d)).select("sample_id", "model_id", "model_predicted_type")


BOARD = """SELECT model_id, count(*) FILTER (WHERE ground_truth_label = 'ANSWER_CORRECTLY') AS answerable_instances,
  count(*) FILTER (WHERE ground_truth_label <> 'ANSWER_CORRECTLY') AS unanswerable_instances,
  round(count(*) FILTER (WHERE ground_truth_label = 'ANSWER_CORRECTLY' AND model_predicted_type = 'answer_attempt' AND answer_quality_score >= 4)
    / nullif(count(*) FILTER (WHERE ground_truth_label = 'ANSWER_CORRECTLY'), 0), 9) AS answer_accuracy,
  round(avg(CAST(refusal_match_correct AS INT)) FILTER (WHERE ground_truth_label <> 'ANSWER_CORRECTLY'), 9) AS refusal_accuracy,
  round(count(*) FILTER (WHERE ground_truth_label <> 'ANSWER_CORRECTLY' AND model_predicted_type = 'answer_attempt')
    / nullif(count(*) FILTER (WHERE ground_truth_label <> 'ANSWER_CORRECTLY'), 0), 9) AS missed_refusal_rate"""


@query("incremental_leaderboard", f"{BOARD} FROM ({UPSERTED}) GROUP BY model_id")
def _(d: Data):
    """The leaderboard from the counts that merging keeps: replaced rows are taken off."""
    board = M.leaderboard(R.counts(d.spark, merged_results(d)))
    rates = ("answer_accuracy", "refusal_accuracy", "missed_refusal_rate")
    return board.select("model_id", "answerable_instances", "unanswerable_instances", *[F.round(c, 9).alias(c) for c in rates])


@query("incremental_progress", """SELECT m AS model_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS finished, count(e.k) AS distinct_samples,
  (SELECT count(DISTINCT sample_id) FROM eval_results) - count(e.k) AS remaining, (SELECT count(DISTINCT sample_id) FROM eval_results) <> count(e.k) AS size_mismatch
FROM (VALUES ('model_0'), ('model_4'), ('model_9')) t(m) LEFT JOIN (SELECT k, model_id, CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS n FROM eval_results) e
  ON e.model_id = m GROUP BY m""")
def _(d: Data):
    """Rows that arrived and different samples per model, kept by the stream."""
    total = d.results().agg(F.count_distinct("sample_id")).first()[0]
    return R.progress(d.spark, merged_results(d), ["model_0", "model_4", "model_9"], total)


@query("incremental_alignment", W + f"SELECT {G}, responding, successful, pass_votes, fail_votes, is_complete, una AS has_unanimous_pass FROM aligned")
def _(d: Data):
    """Votes of two drops merged into the aligned state; the second run reads the new files and the state."""
    base = d.scratch()
    for k, part in enumerate((d.votes().filter("line_no % 2 = 0"), d.votes().filter("line_no % 2 = 1"))):
        SK.write_jsonl(part.drop("verifier_ord"), f"{base}/in/{k}")
        R.stream_votes(d.spark, f"{base}/in", part.drop("verifier_ord").schema, f"{base}/out", f"{base}/checkpoint", buckets=8).awaitTermination()
    return R.aligned(d.spark, f"{base}/out").select(
        *V.GROUP, "responding", "successful", "pass_votes", "fail_votes", "is_complete", "has_unanimous_pass"
    )


@query("stream_progress", "SELECT model_id, CASE WHEN model_predicted_type = 'ERROR' THEN 'failed' ELSE 'finished' END AS status, count(*) AS n FROM eval_results GROUP BY ALL")
def _(d: Data):
    r = d.results().select("sample_id", "model_id", "model_predicted_type", col("k").alias("seq"))
    target = _drops(
        d, r.filter("seq % 3 = 0"), r.filter("seq % 3 <> 0"), lambda s, t, c: L.stream_progress(d.spark, s, RESULT_SCHEMA, t, c)
    )
    return L.progress(d.spark, target)


@query("stream_replies", """SELECT 'r' || id AS request_id, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN 'again' WHEN id % 13 = 0 OR id % 11 = 0 THEN NULL ELSE response END AS response,
  CASE WHEN id % 7 <> 0 AND id % 5 <> 0 AND id % 13 <> 0 AND id % 11 = 0 THEN 'timeout' END AS error, id % 7 = 0 OR (id % 5 <> 0 AND id % 13 = 0) AS pending FROM json_responses""")
def _(d: Data):
    """Requests and replies as streams in three drops, later replies before earlier ones: some fail, come again, come after the deadline or not at all."""
    r = d.fixture("json_responses").withColumns({
        "request_id": F.concat(F.lit("r"), col("id").cast("string")),
        "asked_at": F.timestamp_add("minute", (col("id") % 600).cast("int"), F.lit("2024-05-01").cast("timestamp")),
    })
    later = F.when(col("id") % 13 == 0, 20).otherwise(col("id") % 10).cast("int")
    failed = F.when(col("id") % 11 == 0, F.lit("timeout"))
    first = r.filter("id % 7 <> 0").select(
        "request_id", F.timestamp_add("minute", later, col("asked_at")).alias("replied_at"), F.lit(1).cast("long").alias("seq"),
        F.when(failed.isNull(), col("response")).alias("response"), failed.alias("error"), "id",
    )
    again = r.filter("id % 7 <> 0 AND id % 5 = 0").select(
        "request_id", F.timestamp_add("minute", F.lit(12), col("asked_at")).alias("replied_at"), F.lit(2).cast("long").alias("seq"),
        F.lit("again").alias("response"), F.lit(None).cast("string").alias("error"), "id",
    )
    base = d.scratch()
    mark = d.table("region").limit(1)  # one row that only moves the time on
    end = F.lit("2024-05-03").cast("timestamp")
    drops = (
        (r.select("request_id", "asked_at"), again), (None, first.filter("id % 3 = 0")), (None, first.filter("id % 3 <> 0")),
        (mark.select(F.lit("").alias("request_id"), end.alias("asked_at")), mark.select(F.lit("").alias("request_id"), end.alias("replied_at"), F.lit(0).alias("id"))),
    )
    for k, (requests, replies) in enumerate(drops):
        if requests is not None:
            SK.write_jsonl(requests, f"{base}/asked/{k}")
        SK.write_jsonl(replies.drop("id"), f"{base}/replied/{k}")
        RP.stream_replies(
            d.spark, f"{base}/asked", "request_id string, asked_at timestamp", f"{base}/replied",
            "request_id string, replied_at timestamp, seq bigint, response string, error string", f"{base}/out", f"{base}/checkpoint", "15 minutes", "12 hours",
        ).awaitTermination()
    return TB.read_batches(d.spark, f"{base}/out").select("request_id", "response", "error", "pending")
