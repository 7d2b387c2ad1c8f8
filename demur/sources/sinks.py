"""Writers. Every task writes its own part files; nothing is gathered first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.sources.tables import append_batch


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """JSON lines, text as it is, null fields kept. ``compression`` as Spark's JSON writer has it; readers see by the file's name."""
    df.write.mode(mode).option("ignoreNullFields", False).option("compression", compression or "none").json(path)


def write_by_pair(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per (generator, verifier); a pair without rows gets none.

    The rebalance hint lets adaptive execution merge small partitions and split a pair
    that holds a large share of the rows, instead of one task per pair.
    """
    pairs = df.hint("rebalance", F.col("generator_model"), F.col("verifier_model"))
    pairs.write.mode(mode).partitionBy("generator_model", "verifier_model").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_results(df: DataFrame, path: str, batch: str | None = None) -> bool:
    """Add a batch to the results.

    With the name of the batch it counts once, however often the job is run, and a reader sees
    all of it or nothing (``tables.read_batches``, which ``read_results`` uses for such a path).
    Without a name it is a plain append: a repeated job appends again.
    """
    if batch is not None:
        return append_batch(df, path, batch)
    df.write.mode("append").parquet(path)
    return True
