"""Run registered queries on Spark and their SQL on DuckDB and compare.

    python -m checks.compare [--sf DIR] [key ...]
"""

from __future__ import annotations

import argparse
import math
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def local_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("demur")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def family(t: str) -> str:
    t = t.lower()
    for name, words in (
        ("double", ("double", "float")), ("bool", ("boolean",)), ("string", ("string", "varchar")), ("bigint", ("bigint", "long")),
        ("int", ("int",)),
    ):
        if t.startswith(words):
            return name
    return t


def compare(spark: SparkSession, con, key: str, sf_dir: str, queries: dict, oracles: dict) -> tuple[bool, str]:
    t0 = time.time()
    df = queries[key](spark, sf_dir)
    got = df.collect()
    secs = time.time() - t0
    if key not in oracles:
        return True, f"{len(got)} rows, no oracle, {secs:.1f}s"
    rel = con.sql(oracles[key])
    want_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns differ: spark {sorted(df.columns)} oracle {sorted(rel.columns)}"
    types = [
        f"{n}: {t} / {want_types[n]}" for n, t in df.dtypes
        if family(t) != family(want_types[n]) and not t.startswith(("array", "struct", "map"))
    ]
    a, b = rows_of(df.columns, got), rows_of(list(rel.columns), want)
    if a != b:
        only_a, only_b = list((a - b).items())[:2], list((b - a).items())[:2]
        return False, f"{len(got)} / {len(want)} rows; {sum((a - b).values())} differ\n   spark  {only_a}\n   oracle {only_b}\n   columns {sorted(df.columns)}"
    note = f" TYPES {types}" if types else ""
    empty = " EMPTY" if not got else ""
    return not types, f"{len(got)} rows, {secs:.1f}s{note}{empty}"


def main() -> int:
    from checks.catalogue_of_queries import ORACLES, QUERIES

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    spark, con = local_session(), duck(args.sf)
    bad = 0
    keys = [k for k in QUERIES if not args.keys or any(k == w or (w.endswith("*") and k.startswith(w[:-1])) for w in args.keys)]
    for key in keys:
        try:
            ok, text = compare(spark, con, key, args.sf, QUERIES, ORACLES)
        except Exception as e:  # report and go on with the next query
            ok, text = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(("ok  " if ok else "FAIL"), key, text, flush=True)
    print(f"{len(keys) - bad} of {len(keys)} agree")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
