"""Intermediate tables in the shared folder of the cluster.

A plan that uses one result several times writes it once and reads it back: the work is
not repeated, the lineage is cut, and losing executors loses nothing. The folder is the
one the caller gives or the session names in ``spark.checkpoint.dir``; only a local session
may go without one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    base = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark.sparkContext.master):
            raise ValueError("give a folder that all executors share, or set spark.checkpoint.dir")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/demur-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write the frame to shared storage and read it back."""
    path = shared_path(df.sparkSession, name, folder)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._demur_path = path
    return back


#: rows that are broadcast, at about 1 KB each
FEW = 50_000


def join_way(df: DataFrame, few: int = FEW) -> str:
    """The hint for a side of a join: ``broadcast`` if it was written by ``materialise`` and has few rows, else ``merge``.

    Left to itself the planner estimates a table that is still to be computed by the bytes of the
    files below it, whatever an ``explode`` makes of their rows, and may gather all of it on the driver.
    """
    if getattr(df, "_demur_path", None) and df.limit(few + 1).count() <= few:
        return "broadcast"
    return "merge"


def discard(written: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    path = getattr(written, "_demur_path", None)
    if path:
        hadoop_path = written.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(written.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)

