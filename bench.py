"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4), BENCH_REPEAT (default 2,
the best run counts). A query's result is written to the no-op sink, so every row and column
is produced and nothing is sent to Python.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "leaderboard", "evaluator_metrics", "confusion_matrix", "calibration_decomposed", "refusal_by_class", "detailed_results",
    "multidoc_metrics", "breakdowns", "run_progress", "verifier_alignment", "agreement_funnel", "pass_rate_matrix",
    "pairwise_agreement", "effectiveness", "stratified_sample", "common_tasks", "stratified_dataset", "unified_record",
    "unique_key", "compose_passages", "apply_patches", "parse_fenced_json", "parse_judgement_lines", "parse_comprehensive_judgement",
    "dual_outcome", "perturbation_grid", "generator_requests", "resume_pairs", "resume_verifications", "dedupe_last", "write_by_pair",
)


def session(cpus: str):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("demur-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "5g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from checks.catalogue_of_queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "4"))
    QUERIES["leaderboard"](spark, sf_dir).collect()  # start-up of the session is not measured
    seconds: dict[str, float] = {}
    for name in names:
        best = float("inf")
        for _ in range(repeat):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
