"""Files: line order, missing paths, values pandas writes, restarted streams."""

from pyspark.sql import functions as F

from demur import schemas
from demur.sources import readers as RD
from demur.sources import sinks as SK
from demur.streaming import logs as L


def test_line_order_across_splits_of_one_file(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text("".join('{"n": %d}\n' % i for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    df = RD.read_jsonl(spark, str(path), "n bigint, line_no bigint", numbered=True)
    assert RD._raw_jsonl(spark, str(path), "n bigint").select("_block").distinct().count() > 1
    rows = df.orderBy("line_no").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.n for r in rows] == list(range(5000)) and len({r.line_no for r in rows}) == 5000


def test_missing_files_read_as_empty(spark, tmp_path):
    assert RD.read_jsonl(spark, str(tmp_path / "no.jsonl"), "a string").count() == 0
    assert RD.read_verifications(spark, str(tmp_path)).count() == 0
    assert RD.read_results(spark, str(tmp_path / "no.csv")).count() == 0


def test_plain_files_in_folders(spark, tmp_path):
    folder = tmp_path / "dataset_gpt"
    folder.mkdir()
    (folder / "x_verifications_nova.jsonl").write_text(
        '{"source_qid": "q", "verification_successful": true, "verification_response": {"verification_result": "PASS", "identified_issues": ["é"]}}\nbroken\n'
    )
    rows = RD.read_verifications(spark, str(tmp_path), numbered=True).collect()
    assert [(r.generator_model, r.verifier_model, r.verification_result, r.identified_issues) for r in rows] == [("gpt", "nova", "PASS", ["é"])]


def test_csv_as_pandas_writes_it(spark, tmp_path):
    path = tmp_path / "r.csv"
    names = schemas.RESULTS_MULTI.replace(" string", "").replace(" bigint", "").replace(" boolean", "").replace(" double", "").split(", ")
    values = {n: "" for n in names} | {"model_id": "m", "entry_idx": "3", "query": '"a ""b"",\nc"', "is_answerable": "True", "raf_score": "1.0", "false_refusal": "False"}
    path.write_text(",".join(names) + "\n" + ",".join(values[n] for n in names) + "\n")
    r = RD.read_results(spark, str(path), "multi").collect()[0]
    assert (r.entry_idx, r.query, r.is_answerable, r.raf_score, r.false_refusal, r.missed_refusal) == (3, 'a "b",\nc', True, 1, False, None)


def test_nulls_and_other_scripts_stay_in_jsonl(spark, tmp_path):
    path = str(tmp_path / "out")
    SK.write_jsonl(spark.createDataFrame([("日本", None)], "a string, b string"), path)
    assert spark.read.text(path).collect()[0].value == '{"a":"日本","b":null}'


def test_a_restarted_stream_takes_new_files_only(spark, tmp_path):
    schema = "sample_id string, model_id string, v int, seq bigint"
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def drop(name, rows):
        SK.write_jsonl(spark.createDataFrame(rows, schema).coalesce(1), f"{src}/{name}")
        L.stream_upsert(spark, src, schema, out, ck).awaitTermination()

    drop("a", [("s1", "m", 1, 1), ("s2", "m", 1, 2)])
    drop("b", [("s2", "m", 2, 1)])
    L.stream_upsert(spark, src, schema, out, ck).awaitTermination()  # nothing new
    assert spark.read.parquet(out).count() == 3
    assert {r.sample_id: r.v for r in L.latest(spark, out).collect()} == {"s1": 1, "s2": 2}
    compacted = str(tmp_path / "compacted")
    L.compact(spark, out, compacted)
    assert L.latest(spark, compacted).agg(F.sum("v")).collect()[0][0] == 3
