"""CSV cut into splits at any byte reads like the whole file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from demur.sources import csv_splits as CS
from demur.sources import readers as RD


@pytest.fixture
def split_bytes(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]

    def set_to(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")

    yield set_to
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def cells(rng):
    return "".join(rng.choice(['a', 'é', ' ', ',', '"', '\n', '""', 'x\n\n', '日']) for _ in range(rng.randint(0, 12)))


def write(path, rows, end="\r\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    path.write_bytes(out.getvalue().encode())


def read(spark, path):
    rows, names = CS.read_csv(spark, str(path))
    return [tuple(names[r.layout]) + tuple("" if c is None else c for c in r.cells[: len(names[r.layout])]) for r in rows.collect()]


@pytest.mark.parametrize("size,end", [(16, "\n"), (40, "\r\n"), (77, "\n"), (300, "\r\n"), (1 << 20, "\n")])
def test_any_split_gives_the_same_records(spark, tmp_path, split_bytes, size, end):
    rng = random.Random(size)
    folder = tmp_path / "in"
    folder.mkdir()
    want = []
    for k, header in enumerate([("id", "t", "u"), ("id", "t", "u"), ("u", "id")]):
        rows = [tuple(f"{k}-{n}" if h == "id" else cells(rng) for h in header) for n in range(60)]
        rows.append(tuple(f"{k}-long" if h == "id" else "line\n" * 100 + 'say ""' for h in header))  # over many splits
        write(folder / f"{k}.csv", [header, *rows], end)
        want += [header + r for r in rows]
    split_bytes(size)
    assert sorted(read(spark, folder)) == sorted(want)


def test_more_splits_than_pass_through_the_driver(spark, tmp_path, split_bytes, monkeypatch):
    rng = random.Random(4)
    write(tmp_path / "a.csv", [("id", "t"), *[(str(n), cells(rng)) for n in range(50)]])
    split_bytes(30)
    few = sorted(read(spark, tmp_path / "a.csv"))
    monkeypatch.setattr(CS, "MAX_SPLITS", 1)
    assert sorted(read(spark, tmp_path / "a.csv")) == few and len(few) == 50


def test_one_file_over_many_tasks(spark, tmp_path, split_bytes):
    path = tmp_path / "r.csv"
    write(path, [("model_id", "query", "answer_quality_score"), *[(f"m{n % 3}", f"first\nsecond {n}", "5.0") for n in range(2000)]])
    split_bytes(4096)
    df = RD.read_results(spark, str(path)).select("model_id", "query", "answer_quality_score")
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    assert {(r.model_id, r.query, r.answer_quality_score) for r in df.collect()} == {(f"m{n % 3}", f"first\nsecond {n}", 5.0) for n in range(2000)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all("file" in line for line in exchanges)  # of the pieces alone


def test_empty_files_and_headers_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("model_id,query\n")
    assert RD.read_results(spark, str(tmp_path)).collect() == []
    (tmp_path / "c.csv").write_text("﻿model_id,query\nm,q\n\n\nn,\n")
    assert sorted((r.model_id, r.query) for r in RD.read_results(spark, str(tmp_path)).collect()) == [("m", "q"), ("n", None)]
