"""Evaluation results and votes as tables that are kept up to date by merging.

``merge_results`` keeps the last row per (sample, model) and, beside it, the counts that all
metrics follow from: a row that replaces another adds itself and takes the other off, so a
leaderboard needs the counts alone. ``merge_votes`` keeps the aligned votes: per content
one packed long per verifier, of which the highest counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from demur import vocab
from demur.functions.columns import col, literal_table
from demur.operators import metrics, voting
from demur.sources import tables
from demur.sources.readers import number_lines

KEYS = ("sample_id", "model_id")
_COUNTED = ("model_id", "ground_truth_label", "model_predicted_type", "perturbation_class", "intensity", "generator_model", "confidence_level",
            "refusal_match_correct", "answer_quality_score")
ARRIVED = "arrived"


def _last_wins(keys: Sequence[str], seq: str):
    """New rows of the touched buckets: per key the last one, with what it replaced in this version. Rows are
    shuffled once, to where they are written."""
    def combine(old: DataFrame | None, batch: DataFrame, number: int) -> DataFrame:
        counted = [c for c in _COUNTED if c in batch.columns]
        before = T.StructType([batch.schema[c] for c in counted])
        new = batch.withColumn("_version", F.lit(number).cast("long"))
        both = new if old is None else old.drop("_before").unionByName(new, allowMissingColumns=True)
        last = Window.partitionBy(*tables.PLACE, *keys).orderBy(F.desc("_version"), F.desc(seq))
        # of a key there is one old row at most, behind the new ones; the same order, so that rows are sorted once
        whole = last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        earlier = F.max(F.when(col("_version") < number, F.struct(*counted))).over(whole)
        ranked = both.repartition(*tables.PLACE).withColumns({"_earlier": earlier, "_rn": F.row_number().over(last)}).filter("_rn = 1")
        names = [c for c in both.columns if c not in keys]
        return ranked.select(*keys, *names, F.when(col("_version") == number, col("_earlier")).cast(before).alias("_before"))

    return combine


def _counts(last: DataFrame | None, rows: DataFrame, number: int, batch: DataFrame) -> DataFrame:
    """Counts of the rows as they are now: those of before, plus what came, minus what was replaced."""
    changed = rows.filter(col("_version") == number)
    counted = [f.name for f in rows.schema["_before"].dataType.fields]
    plus = metrics.condense(changed.select(*counted))
    gone = changed.filter("_before IS NOT NULL").select(*[col(f"_before.{c}").alias(c) for c in counted])
    minus = metrics.condense(gone).withColumn(metrics.WEIGHT, -col(metrics.WEIGHT))
    arrived = batch.groupBy("model_id").agg(F.count(F.lit(1)).alias(ARRIVED))
    delta = plus.unionByName(minus).unionByName(arrived, allowMissingColumns=True)
    every = delta if last is None else last.unionByName(delta, allowMissingColumns=True)
    by = [c for c in every.columns if c not in (metrics.WEIGHT, ARRIVED)]
    sums = every.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (metrics.WEIGHT, ARRIVED)])
    return sums.filter((col(metrics.WEIGHT) != 0) | (col(ARRIVED) != 0))


def merge_results(batch: DataFrame, path: str, source: str, number: int, keys: Sequence[str] = KEYS, seq: str = "seq", buckets: int = tables.BUCKETS) -> bool:
    """Merge a batch of results: later batches, and within a batch the highest ``seq``, win."""
    return tables.merge_batch(batch, path, source, number, keys, _last_wins(keys, seq), _counts, buckets, dealt=True)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """Counted combinations of the current results; the metrics take them in place of the results."""
    found = tables.read_summary(spark, path)
    if found is None:
        raise ValueError(f"no results at {path}")
    return found.filter(col(metrics.WEIGHT) != 0).drop(ARRIVED)


def progress(spark: SparkSession, path: str, models: Sequence[str], total: int) -> DataFrame:
    """As ``metrics.run_progress``, from the counts alone: rows that arrived, different samples, what remains of ``total``."""
    found = tables.read_summary(spark, path)
    asked = literal_table(spark, ("model_id",), [(m,) for m in models])
    if found is None:
        done = spark.createDataFrame([], "model_id string, finished bigint, distinct_samples bigint")
    else:
        done = found.groupBy("model_id").agg(F.sum(ARRIVED).alias("finished"), F.sum(metrics.WEIGHT).alias("distinct_samples"))
    n = F.coalesce("distinct_samples", F.lit(0))
    return asked.join(done, "model_id", "left").select(
        "model_id", F.coalesce("finished", F.lit(0)).alias("finished"), n.alias("distinct_samples"),
        (F.lit(total) - n).alias("remaining"), (F.lit(total) != n).alias("size_mismatch"),
    )


def status(spark: SparkSession, path: str) -> DataFrame:
    """Samples per model that are finished or failed."""
    state = F.when(col("model_predicted_type") == "ERROR", "failed").otherwise("finished")
    return counts(spark, path).groupBy("model_id", state.alias("status")).agg(F.sum(metrics.WEIGHT).alias("n"))


# --- votes ----------------------------------------------------------------------------------------

#: batches take the bits of a line number above these
_LINES = 31


def merge_votes(
    batch: DataFrame, path: str, source: str, number: int, content: Sequence | None = None,
    verifiers: Sequence[str] = vocab.VERIFIERS, buckets: int = tables.BUCKETS,
) -> bool:
    """Merge votes into the aligned state. A vote's ``line_no`` decides within and between batches.

    ``batch_lines`` gives lines that go on from batch to batch. No texts are kept: the state
    is one row per content.
    """
    def combine(old: DataFrame | None, votes: DataFrame, _: int) -> DataFrame:
        new = voting.packed_votes(votes, content or voting.CONTENT_FIELDS, verifiers)
        return new if old is None else voting.merge_packed(old.unionByName(new))

    keyed = batch.withColumn("content_key", voting.content_key(content or voting.CONTENT_FIELDS))
    return tables.merge_batch(keyed, path, source, number, ("generator_model", "content_key"), combine, buckets=buckets)


def aligned(spark: SparkSession, path: str, verifiers: Sequence[str] = vocab.VERIFIERS) -> DataFrame:
    """The aligned votes as ``voting.align`` gives them, by reading the state alone."""
    state = tables.version(spark, path)
    if state is None:
        raise ValueError(f"no votes at {path}")
    return voting.unpacked_votes(tables._rows(spark, path, state), verifiers)


def batch_lines(batch: DataFrame, number: int) -> DataFrame:
    """``line_no`` for votes read from the files of one batch (with ``_file`` and ``_block``), above those of all earlier batches."""
    log = F.concat_ws("/", "generator_model", "verifier_model")
    return number_lines(batch, log).withColumn("line_no", F.lit(number).cast("long") * (1 << _LINES) + col("line_no"))


# --- streams --------------------------------------------------------------------------------------


def _stream(spark: SparkSession, source: str, schema: str | T.StructType, checkpoint: str, each) -> StreamingQuery:
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.readStream.schema(struct).option("recursiveFileLookup", True).json(source)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_results(
    spark: SparkSession, source: str, schema: str | T.StructType, target: str, checkpoint: str, buckets: int = tables.BUCKETS
) -> StreamingQuery:
    """Merge new result files once each; a batch that is repeated after a crash changes nothing."""
    return _stream(spark, source, schema, checkpoint, lambda batch, number: merge_results(batch, target, checkpoint, number, buckets=buckets) and None)


def stream_votes(
    spark: SparkSession, source: str, schema: str | T.StructType, target: str, checkpoint: str, buckets: int = tables.BUCKETS
) -> StreamingQuery:
    """Merge new votes, which carry their ``line_no``, into the aligned state."""
    return _stream(spark, source, schema, checkpoint, lambda batch, number: merge_votes(batch, target, checkpoint, number, buckets=buckets) and None)
