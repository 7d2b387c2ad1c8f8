"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that the session names in ``spark.checkpoint.dir``,
which all executors of a cluster share. Only a local session may go without one.
"""

from __future__ import annotations

import ctypes
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python are cut again into pieces of about this many characters
BATCH_CHARS = 2_000_000
#: bits of broadcast filters (8 MB)
FILTER_BITS = 1 << 26


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="demur-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/demur-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back; cuts the lineage."""
    path = shared_folder(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_path = path  # so that forget() can find it
    return back


def forget(*tables: DataFrame) -> None:
    """Delete written tables that no result refers to any more."""
    for df in tables:
        path = getattr(df, "_stored_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns an operator looks at; a null text counts as empty.

    Whatever other columns the table has stays behind, so no name of theirs can clash.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def checksum_part(ident: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts: the folds that the queries are told to use."""
    column = F.col(ident) if isinstance(ident, str) else ident
    return F.crc32(column.cast("string").cast("binary")) % parts


def salt(ident: str | Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(parts)).cast("int")


def small_batches(
    batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = BATCH_CHARS, rows: int = 5000
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``chars`` bytes of text and ``rows`` rows, or one row.

    Bounds the memory of what is computed per batch whatever the length of the texts.
    """
    for batch in batches:
        offsets = batch.column(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(offsets), 0).to_numpy(zero_copy_only=False)
        start, filled = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (filled + n > chars or i - start >= rows):
                yield batch.slice(start, i - start)
                start, filled = i, 0
            filled += n
        if start < batch.num_rows:
            yield batch.slice(start)
    release_memory()


def release_memory() -> None:
    """Give back what the allocators of a Python worker hold on to after a task.

    Workers live on from stage to stage, and next to a full executor what they merely keep
    can be too much.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)




def attached(df: DataFrame, keys: list[str], ident: str, partial: dict[str, Column], merge: dict[str, Column], salts: int = 64) -> DataFrame:
    """Add values of each key's group to its rows, with no group in one task.

    ``partial`` are aggregates per key and salt, ``merge`` the same over those. A group is
    summed up per salt, then over its salts, and looked up by key and salt, so that a key
    holding a third of all rows is dealt to as many tasks as there are salts.
    """
    salted = df.withColumn("_salt", salt(ident, salts))
    parts = salted.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    whole = parts.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()], F.collect_set("_salt").alias("_salts"))
    per_salt = whole.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(per_salt, [*keys, "_salt"]).drop("_salt")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the links (``a``, ``b``): ``node``, ``label`` (smallest node).

    Rounds of taking the smallest label among neighbours, then the label's own label, until
    nothing changes. Each round is a written table; joins are between written tables, so
    adaptive execution can split a node with very many links.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), name)
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        lower = stored(
            labels.join(heard, labels["node"] == heard["a"]).select("node", F.least("label", "heard").alias("label"), F.col("label").alias("old")), name
        )
        own = lower.select(F.col("node").alias("via"), F.col("label").alias("jump"))
        jumped = stored(lower.join(own, F.col("label") == F.col("via")).select("node", F.least("label", "jump").alias("label"), "old"), name)
        changed = jumped.filter("label != old").limit(1).count()
        forget(labels, lower)
        labels = jumped
        if not changed:
            forget(both)
            return labels.select("node", "label")


def fitted(rows: DataFrame, fit: Callable[[list[dict]], object]) -> object:
    """A model or plan made from a bounded number of rows, in a task of its own.

    The driver gets the result only, and none of the numerical libraries' threads.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = fit([r for batch in batches for r in batch.to_pylist()])
        yield pa.RecordBatch.from_pydict({"made": pa.array([pickle.dumps(made)], pa.binary())})
        del made
        release_memory()

    found = rows.repartition(1).mapInArrow(run, "made binary").collect()
    return pickle.loads(bytes(found[0]["made"])) if found else fit([])


def with_maybe(df: DataFrame, key: Column, members: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Add ``_maybe``: false only for rows whose key is not among the members (one long column).

    A bit per hashed key, in bitmaps that are broadcast: bits / 8 bytes at most, whatever the
    input. With many members more rows are true, so it may spare work but decide nothing.
    """
    bit = F.pmod(F.xxhash64(F.col(members.columns[0])), F.lit(bits)) + 1
    maps = members.select(bit.alias("bit")).distinct().groupBy(F.bitmap_bucket_number("bit").alias("_bucket"))
    maps = F.broadcast(maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bitmap")))
    own = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    placed = df.withColumns({"_bucket": F.bitmap_bucket_number(own), "_at": F.bitmap_bit_position(own)}).join(maps, "_bucket", "left")
    maybe = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
    return placed.withColumn("_maybe", maybe).drop("_bucket", "_at", "_bitmap")
