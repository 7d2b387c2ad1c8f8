"""Streams of requests and replies: deadlines, repeated and failed replies, crashes."""

import pytest
from pyspark.errors import StreamingQueryException

from demur.sources import sinks as SK
from demur.sources import tables as TB
from demur.streaming import replies as RP

REQUESTS = "request_id string, asked_at timestamp, prompt string"
REPLIES = "request_id string, replied_at timestamp, seq bigint, response string, error string"


def at(minute):
    return f"2024-05-01 {10 + minute // 60:02d}:{minute % 60:02d}:00"


def asked(spark, *rows):
    return spark.createDataFrame([(i, at(m), f"prompt {i}") for i, m in rows], "request_id string, asked_at string, prompt string").selectExpr(
        "request_id", "CAST(asked_at AS timestamp) AS asked_at", "prompt")


def replied(spark, *rows):
    return spark.createDataFrame([(i, at(m), s, r, e) for i, m, s, r, e in rows], "request_id string, replied_at string, seq bigint, response string, error string").selectExpr(
        "request_id", "CAST(replied_at AS timestamp) AS replied_at", "seq", "response", "error")


ASKED = (("a", 0), ("b", 0), ("c", 1), ("d", 2), ("e", 3), ("f", 5))
REPLIED = (
    ("a", 1, 1, "early", None), ("a", 3, 2, "late", None), ("a", 4, 3, None, "timeout"),  # the last successful one counts
    ("b", 2, 1, None, "timeout"), ("b", 5, 2, None, "refused"),  # only failures: the last one
    ("c", 30, 1, "after the deadline", None), ("d", 12, 1, "on the deadline", None),
    ("f", 4, 1, "before the request", None), ("unknown", 4, 1, "to nobody", None),
)
WANTED = {
    "a": ("late", None, False), "b": (None, "refused", False), "c": (None, None, True),
    "d": ("on the deadline", None, False), "e": (None, None, True), "f": (None, None, True),
}


def found(rows):
    out = {r.request_id: (r.response, r.error, r.pending) for r in rows}
    assert len(out) == len(rows) and all(r.prompt == f"prompt {r.request_id}" for r in rows)
    return out


def test_tables_follow_the_deadline(spark):
    rows = RP.attach_in_time(asked(spark, *ASKED), replied(spark, *REPLIED), "10 minutes").collect()
    assert found(rows) == WANTED


def test_rows_without_times_are_not_used_and_repeated_requests_count_once(spark):
    requests = asked(spark, ("a", 0), ("a", 0)).unionByName(spark.createDataFrame([("x", None, "p")], REQUESTS))
    answers = replied(spark, ("a", 1, 1, "yes", None)).unionByName(spark.createDataFrame([("a", None, 9, "no time", None)], REPLIES))
    assert found(RP.attach_in_time(requests, answers, "10 minutes").collect()) == {"a": ("yes", None, False)}
    assert RP.attach_in_time(requests.limit(0), answers, "10 minutes").collect() == []


def drop(spark, base, name, requests=(), answers=()):
    SK.write_jsonl(asked(spark, *requests), f"{base}/asked/{name}")
    SK.write_jsonl(replied(spark, *answers), f"{base}/replied/{name}")


def run(spark, base):
    query = RP.stream_replies(spark, f"{base}/asked", REQUESTS, f"{base}/replied", REPLIES, f"{base}/out", f"{base}/checkpoint", "10 minutes", "30 minutes")
    query.awaitTermination()
    return query


def out(spark, base):
    rows = TB.read_batches(spark, f"{base}/out", "request_id string, asked_at timestamp, prompt string, response string, error string, pending boolean")
    return rows.collect()


def test_three_drops_give_the_result_of_the_tables(spark, tmp_path):
    base = str(tmp_path)
    drop(spark, base, "1", ASKED, REPLIED[:2])
    run(spark, base)
    assert out(spark, base) == []  # nobody's time is up
    drop(spark, base, "2", (), REPLIED[5:])
    run(spark, base)
    drop(spark, base, "3", (), REPLIED[2:5])  # arrive after newer ones
    run(spark, base)
    drop(spark, base, "4", (("", 120),), (("", 120, 0, None, None),))
    run(spark, base)
    assert found(out(spark, base)) == WANTED
    assert run(spark, base).exception() is None and found(out(spark, base)) == WANTED  # nothing comes twice


def test_a_crash_before_the_record_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    drop(spark, base, "1", ASKED, REPLIED)
    run(spark, base)
    drop(spark, base, "2", (("", 120),), (("", 120, 0, None, None),))

    def crash(*_):
        raise OSError("gone")

    monkeypatch.setattr(TB, "publish", crash)
    with pytest.raises(StreamingQueryException):
        run(spark, base)
    monkeypatch.undo()
    run(spark, base)
    assert found(out(spark, base)) == WANTED


def test_a_reply_behind_the_watermark_is_dropped_and_its_request_pending(spark, tmp_path):
    base = str(tmp_path)
    drop(spark, base, "1", (("a", 0), ("", 120)), (("", 120, 0, None, None),))
    run(spark, base)
    drop(spark, base, "2", (), (("a", 1, 1, "much too late", None),))
    run(spark, base)
    assert found(out(spark, base)) == {"a": (None, None, True)}


def test_the_join_is_on_the_id_and_no_python_runs(spark):
    plan = RP.attach_in_time(asked(spark, *ASKED), replied(spark, *REPLIED), "10 minutes")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "ArrowEval" not in plan
