"""Repeatable sampling, deduplication and sample reports.

A sample is "the first n in the order of md5(seed:id)". The order depends on nothing but
the rows, so the same rows come out whatever the partitioning. The rows of a group are
counted by the first digits of the hash; running sums over these counts tell which digits
belong to the sample as a whole, and only rows with the digits at the cut are ranked. So
no task ever sorts a whole group, whatever n is. Only ids travel through this; the full
rows are picked up afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demur import vocab
from demur.functions.columns import col, literal_array, literal_table, percent, sample_order
from demur.functions.keys import stratum_key

#: leading hex digits of the hash that rows are counted by (65,536 buckets a group)
DIGITS = 4


def first_n(df: DataFrame, keys: Sequence[str], n: int | Column, order: str = "_h", ident: str = "content_key") -> DataFrame:
    """The first n rows of every group in the order of a hex hash, ties by id; any n.

    ``n`` may be a column of ``df`` that is the same within a group. ``df`` is read twice and
    should be narrow.
    """
    limit = F.lit(n) if isinstance(n, int) else n
    bucketed = df.withColumns({"_bucket": F.substring(order, 1, DIGITS), "_limit": limit.cast("long")})
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"), F.max("_limit").alias("_most"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).filter(col("_before") < col("_most"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(order, ident)
    kept = bucketed.join(cut.select(*keys, "_bucket", "_before"), [*keys, "_bucket"]).withColumn("_place", F.row_number().over(within))
    return kept.filter(col("_before") + col("_place") <= col("_limit")).select(*df.columns)


def stratified_ids(
    df: DataFrame, ident: str = "content_key", per_stratum: int = vocab.PER_STRATUM,
    target: int = vocab.PER_GENERATOR, seed: int = vocab.SEED,
) -> DataFrame:
    """(generator, id, stratum) of the stratified sample.

    Each generator gives up to ``per_stratum`` rows from each of the 18 strata and is then
    filled up to ``target`` from its unused rows of any stratum. ``df`` is read several times;
    write it first if it is expensive.
    """
    narrow = df.select(
        "generator_model", stratum_key().alias("stratum"), col(ident).alias(ident), sample_order(seed, ident).alias("_h")
    )
    quota = first_n(narrow.filter(col("stratum").isin(*vocab.STRATA)), ["generator_model", "stratum"], per_stratum, ident=ident)
    taken = quota.groupBy("generator_model").agg(F.count(F.lit(1)).alias("_taken"))
    rest = narrow.join(quota.select("generator_model", ident), ["generator_model", ident], "left_anti")
    rest = rest.join(taken, "generator_model", "left")
    missing = F.lit(target) - F.coalesce("_taken", F.lit(0))
    fill = first_n(rest, ["generator_model"], missing, ident=ident)
    columns = ("generator_model", ident, "stratum")
    return quota.select(*columns).unionByName(fill.select(*columns))


def stratified_sample(
    df: DataFrame, ident: str = "content_key", per_stratum: int = vocab.PER_STRATUM,
    target: int = vocab.PER_GENERATOR, seed: int = vocab.SEED,
) -> DataFrame:
    """The sampled rows."""
    ids = stratified_ids(df, ident, per_stratum, target, seed).drop("stratum")
    return df.join(ids, ["generator_model", ident], "left_semi")


def domain_sample(
    df: DataFrame, domains: Sequence[str] = vocab.TARGET_DOMAINS, n: int = vocab.PER_DOMAIN,
    seed: int = vocab.SEED, domain: str = "question_category", ident: str = "sample_id",
) -> DataFrame:
    wanted = df.filter(col(domain).isin(*domains))
    ids = first_n(wanted.select(domain, ident, sample_order(seed, ident).alias("_h")), [domain], n, ident=ident)
    return wanted.join(ids.select(domain, ident), [domain, ident], "left_semi")


def task_sample(common: DataFrame, n: int | None = None, seed: int = vocab.SEED) -> DataFrame:
    """n of the common tasks with all their generators; all when n is absent."""
    if n is None:
        return common
    ids = common.select("task_key").distinct().orderBy(sample_order(seed, "task_key"), "task_key").limit(n)
    return common.join(ids, "task_key", "left_semi")


def dedupe_last(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The row with the highest sequence number per key.

    A rank bounded by 1 is applied before the shuffle too, so a key with very many
    repeats sends one row per task.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return df.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


# --- reports on a finished sample -----------------------------------------------------


def _counts(sample: DataFrame) -> DataFrame:
    return sample.groupBy("generator_model", stratum_key().alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def stratification_report(sample: DataFrame, per_stratum: int = vocab.PER_STRATUM, models: int = len(vocab.VERIFIERS)) -> DataFrame:
    """Per stratum: rows, generators represented, balance and whether the quota is met."""
    seen = _counts(sample).groupBy("stratum").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("models"))
    expected = literal_table(sample.sparkSession, ("stratum", "expected"), [(s, True) for s in vocab.STRATA])
    n = F.coalesce("n", F.lit(0))
    return expected.join(seen, "stratum", "full_outer").select(
        "stratum", F.coalesce("expected", F.lit(False)).alias("expected"), n.alias("count"),
        F.coalesce("models", F.lit(0)).alias("models_represented"), (F.coalesce("models", F.lit(0)) >= 3).alias("is_balanced"),
        F.when(n == 0, "missing").when(n >= per_stratum * models, "met").otherwise("below").alias("status"),
    )


def stratification_summary(report: DataFrame) -> DataFrame:
    seen = col("status") != "missing"
    return report.agg(
        F.count_if(seen).alias("covered_strata"), F.count_if("expected").alias("total_strata"),
        F.count_if(col("status") == "met").alias("strata_meeting_minimum"), F.count_if(col("status") == "below").alias("strata_below_minimum"),
        F.count_if("is_balanced").alias("balanced_strata"), F.sum("count").alias("total_samples"),
    ).withColumn("coverage_percentage", percent("covered_strata", "total_strata"))


def stratification_models(sample: DataFrame, target: int = vocab.PER_GENERATOR) -> DataFrame:
    """Per generator: rows, deviation from the target, strata covered and missing."""
    t = _counts(sample).groupBy("generator_model").agg(
        F.sum("n").alias("sample_count"), F.collect_set("stratum").alias("strata"), F.count(F.lit(1)).alias("strata_covered")
    )
    return t.select(
        "generator_model", "sample_count", (col("sample_count") - target).alias("deviation_from_target"), "strata_covered",
        F.array_sort(F.array_except(literal_array(vocab.STRATA), col("strata"))).alias("missing_strata"),
    )


def sample_crosstab(sample: DataFrame) -> DataFrame:
    """stratum x generator counts with row, column and grand totals ('all')."""
    t = _counts(sample).cube("stratum", "generator_model").agg(F.sum("n").alias("n"))
    return t.select(F.coalesce("stratum", F.lit("all")).alias("stratum"), F.coalesce("generator_model", F.lit("all")).alias("generator_model"), "n")


def missing_strata(sample: DataFrame) -> DataFrame:
    """Strata without any row, overall ('all') and per generator."""
    t = _counts(sample).groupingSets([["generator_model"], []], "generator_model").agg(F.collect_set("stratum").alias("strata"))
    missing = F.explode(F.array_except(literal_array(vocab.STRATA), col("strata")))
    return t.select(F.coalesce("generator_model", F.lit("all")).alias("generator_model"), missing.alias("stratum"))


def merge_results(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("sample_id", "model_id")) -> DataFrame:
    """Earlier and new results; on the same key the new row wins."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return dedupe_last(both, keys, "_seq").drop("_seq")


def run_metadata(sample: DataFrame, mode: str, seed: int = vocab.SEED, target: int = vocab.PER_GENERATOR, per_stratum: int = vocab.PER_STRATUM) -> DataFrame:
    """One-row description of a dataset: sizes and the parameters that made it."""
    t = _counts(sample).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_entries"), F.count_distinct("generator_model").alias("generators"),
        F.count_distinct("stratum").alias("strata"),
    )
    return t.select(
        "total_entries", "generators", "strata", F.lit(f"{mode}_agreement_stratified_sampling").alias("filtering_strategy"),
        F.lit(target).alias("target_samples_per_model"), F.lit(per_stratum).alias("min_samples_per_stratum_per_model"),
        F.lit(len(vocab.STRATA)).alias("num_strata"), F.lit(seed).alias("random_seed"), F.lit(",".join(vocab.VERIFIERS)).alias("verifier_models"),
    )
