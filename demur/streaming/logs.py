"""Incremental versions of the logs: pick up new files once, survive restarts.

All streams run with ``availableNow``: they process what is there and end. The checkpoint
location belongs in shared storage, as does the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from demur.operators.sampling import dedupe_last
from demur.sources import tables


def _files(spark: SparkSession, source: str, schema: str | T.StructType) -> DataFrame:
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.readStream.schema(struct).option("recursiveFileLookup", True).json(source)


def stream_verification_log(
    spark: SparkSession, source: str, schema: str | T.StructType, target: str, checkpoint: str
) -> StreamingQuery:
    """Append every new verification file to a Parquet log exactly once.

    The file sink keeps its own list of committed files, so a batch that is repeated after
    a crash does not show up twice.
    """
    return (
        _files(spark, source, schema).writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_upsert(
    spark: SparkSession, source: str, schema: str | T.StructType, target: str, checkpoint: str
) -> StreamingQuery:
    """Collect result batches so that ``latest`` shows the last row per key.

    Each batch replaces only its own folder, which makes a repeated batch harmless and
    never rewrites rows that are already there.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        _files(spark, source, schema).writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, target: str, keys: Sequence[str] = ("sample_id", "model_id"), seq: str = "seq") -> DataFrame:
    """Current state of an upserted table: per key the highest (batch, sequence)."""
    rows = spark.read.parquet(target).withColumn("_order", F.struct("batch_id", seq))
    return dedupe_last(rows, keys, "_order").drop("_order", "batch_id")


def compact(spark: SparkSession, target: str, out: str, keys: Sequence[str] = ("sample_id", "model_id"), seq: str = "seq") -> None:
    """Write the current state to a new folder, to be used as the next target's start."""
    latest(spark, target, keys, seq).write.mode("errorifexists").parquet(f"{out}/batch_id=-1")


def stream_progress(
    spark: SparkSession, source: str, schema: str | T.StructType, target: str, checkpoint: str
) -> StreamingQuery:
    """Running counts per model and status; the state holds one row per group.

    Every batch writes a version of its own, so a reader (``progress``) finds the version
    before until the new one is complete. Earlier ones are removed.
    """
    status = F.when(F.col("model_predicted_type") == "ERROR", "failed").otherwise("finished")
    counts = _files(spark, source, schema).groupBy("model_id", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))

    def show(table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{target}/version={batch_id}")
        for name in tables.names(spark, target):
            number = name.removeprefix("version=")
            if number.isdigit() and int(number) < batch_id - 1:  # readers may still be at the one before
                tables.delete(spark, f"{target}/{name}")

    return (
        counts.writeStream.outputMode("complete").foreachBatch(show)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def progress(spark: SparkSession, target: str) -> DataFrame:
    """The counts of the last complete version."""
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    filesystem = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = filesystem.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/version=*/_SUCCESS")) or []
    versions = [int(f.getPath().getParent().getName().rpartition("=")[2]) for f in done]
    if not versions:
        return spark.createDataFrame([], "model_id string, status string, n bigint")
    return spark.read.parquet(f"{target}/version={max(versions)}")
