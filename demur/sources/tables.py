"""Tables that grow batch by batch: appended logs and merged tables, both with a commit record.

Data files are written first, to a folder of their own, and count only once a small commit
record names that folder. A record appears under its final name by a rename that fails if
the name is taken, so of two attempts at one batch only the first counts, a repeated batch
changes nothing, and a reader sees all of a batch or none. A crash leaves at most a folder
that no record names; ``vacuum`` removes it.

An *appended* table has a record per batch. A *merged* table keeps its rows by key in hash
buckets; a batch rewrites the buckets that it touches, and the record of the new version says
for every bucket where it lies. Reading is a plain scan: no window, no shuffle, no history.

One writer at a time is expected; a second one fails instead of losing rows. The rename is
atomic on HDFS and on local disks; other stores need a committer that makes it so.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
BUCKET, PART = "_bucket", "_part"
PLACE = (BUCKET, PART)
#: rows of a bucket that lie in one part
PART_ROWS = 250_000
#: of the rows, which every batch that touches their bucket writes again
COMPRESSION = "zstd"
COMMITS, VERSIONS, DATA, SUMMARY = "_commits", "_versions", "data", "summary"


# --- small files ------------------------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    hadoop_path, filesystem = _path(spark, folder)
    if not filesystem.exists(hadoop_path):
        return []
    return [s.getPath().getName() for s in filesystem.listStatus(hadoop_path)]


def _read(spark: SparkSession, path: str) -> str:
    hadoop_path, filesystem = _path(spark, path)
    stream = filesystem.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file appear at once and whole; false if there is one already."""
    final, filesystem = _path(spark, path)
    if filesystem.exists(final):
        return False
    begun, _ = _path(spark, f"{final.getParent()}/.{uuid.uuid4().hex}")
    stream = filesystem.create(begun, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(filesystem.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(begun, final, plain)
    except Py4JJavaError as e:
        filesystem.delete(begun, False)
        if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
            raise
        return False
    return True


def delete(spark: SparkSession, path: str) -> None:
    hadoop_path, filesystem = _path(spark, path)
    filesystem.delete(hadoop_path, True)


# --- appended tables ----------------------------------------------------------------------------


def append_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Add a batch once. False, and nothing is written, if a batch of this name counts already."""
    spark = df.sparkSession
    record = f"{path}/{COMMITS}/{quote(batch, safe='')}"
    if quote(batch, safe="") in names(spark, f"{path}/{COMMITS}"):
        return False
    folder = f"{DATA}/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return publish(spark, record, json.dumps({"folder": folder, "schema": df.schema.jsonValue()}))


def batches(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches that count."""
    return sorted(unquote(n) for n in names(spark, f"{path}/{COMMITS}") if not n.startswith("."))


def _records(spark: SparkSession, path: str) -> list[dict]:
    """Commit records of an appended table, read by tasks where there are many."""
    records = [n for n in names(spark, f"{path}/{COMMITS}") if not n.startswith(".")]
    if len(records) <= 32:
        return [json.loads(_read(spark, f"{path}/{COMMITS}/{n}")) for n in sorted(records)]
    lines = spark.read.option("wholetext", True).text(f"{path}/{COMMITS}")
    return [json.loads(r["value"]) for r in lines.orderBy(F.col("_metadata.file_name")).collect()]  # a row per batch


def read_batches(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """All rows of the batches that count. Batches may have different columns; absent ones are null."""
    records = _records(spark, path)
    if not records:
        if schema is None:
            raise ValueError(f"no batch at {path}, and no schema for an empty table")
        return spark.createDataFrame([], T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    if schema is None:
        fields: dict[str, T.StructField] = {}
        for r in records:
            for f in T.StructType.fromJson(r["schema"]).fields:
                fields.setdefault(f.name, T.StructField(f.name, f.dataType))
        schema = T.StructType(list(fields.values()))
    return spark.read.schema(schema).parquet(*[f"{path}/{r['folder']}" for r in records])


# --- merged tables --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Version:
    """What a merged table consists of: the folder of each bucket, and which batches it holds."""

    number: int
    buckets: int
    keys: tuple[str, ...]
    schema: dict
    folders: Mapping[str, str] = field(default_factory=dict)
    #: last batch of each source
    sources: Mapping[str, int] = field(default_factory=dict)
    #: folder and schema of the summary, if one is kept
    summary: Mapping | None = None


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in names(spark, f"{path}/{VERSIONS}") if n.isdigit())


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The last version, or a given one; None before the first."""
    known = versions(spark, path)
    if not known:
        return None
    text = json.loads(_read(spark, f"{path}/{VERSIONS}/{known[-1] if number is None else number:012d}"))
    return Version(**{**text, "keys": tuple(text["keys"])})


def _rows(spark: SparkSession, path: str, state: Version, only: Sequence[int] | None = None) -> DataFrame:
    """Rows of all buckets or some, each file read once and no other looked at."""
    schema = T.StructType.fromJson(state.schema)
    wanted = state.folders if only is None else {b: f for b, f in state.folders.items() if int(b) in set(only)}
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{folder}/{BUCKET}={b}" for b, folder in sorted(wanted.items())])


def read_merged(spark: SparkSession, path: str, schema: str | None = None, number: int | None = None) -> DataFrame:
    """The table as of its last version, or an earlier one that is still kept."""
    state = version(spark, path, number)
    if state is None:
        if schema is None:
            raise ValueError(f"no version at {path}, and no schema for an empty table")
        return spark.createDataFrame([], schema)
    rows = _rows(spark, path, state)
    return rows.select(*[c for c in rows.columns if not c.startswith("_")])


def read_summary(spark: SparkSession, path: str) -> DataFrame | None:
    """The summary of the last version, a small table."""
    state = version(spark, path)
    if state is None or state.summary is None:
        return None
    return spark.read.schema(T.StructType.fromJson(state.summary["schema"])).parquet(f"{path}/{state.summary['folder']}")


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def part_of(keys: Sequence[str], parts: int) -> Column:
    """Part of a bucket, by other bits of the hash that gives the bucket."""
    return F.pmod(F.shiftright(F.xxhash64(*keys), 24), F.lit(parts)).cast("int")


def merge_batch(
    batch: DataFrame, path: str, source: str, number: int, keys: Sequence[str],
    combine: Callable[[DataFrame | None, DataFrame, int], DataFrame],
    summarise: Callable[[DataFrame | None, DataFrame, int, DataFrame], DataFrame] | None = None, buckets: int = BUCKETS, dealt: bool = False,
) -> bool:
    """Merge a batch once; batches of one source come in the order of their numbers.

    ``combine`` gets the old rows of the touched buckets (None before the first version), the
    batch and the number of the new version, and gives the new rows of these buckets, one per
    key. ``summarise`` gets the last summary, the new rows as written, the version and the
    batch, and gives the new summary. False if the batch is part of the table already.

    With ``dealt``, old rows and batch come to ``combine`` as one frame each with the columns of ``PLACE``, and what it gives
    has them and lies by them already (``repartition(*PLACE)``): the rows are shuffled once for combining and writing.

    The number of buckets is settled by the first batch. Choose it so that a bucket is about a
    file; a batch costs as much as the buckets that it touches.
    """
    spark = batch.sparkSession
    state = version(spark, path)
    if state is not None and state.sources.get(source, -1) >= number:
        return False
    new = 0 if state is None else state.number + 1
    buckets = buckets if state is None else state.buckets
    keys = tuple(keys) if state is None else state.keys
    placed = batch.withColumn(BUCKET, bucket_of(keys, buckets))
    arrived = dict(placed.groupBy(BUCKET).agg(F.count(F.lit(1))).collect())  # at most ``buckets``
    touched = list(arrived)
    old = None if state is None else _rows(spark, path, state, touched)
    folder = f"{DATA}/{new:012d}-{uuid.uuid4().hex}"
    if dealt:
        n = sum(arrived.values()) + (0 if old is None else old.count())
        place = {BUCKET: bucket_of(keys, buckets), PART: part_of(keys, 1 + n // (PART_ROWS * max(1, len(touched))))}
        rows = combine(None if old is None else old.withColumns(place), batch.withColumns(place), new).drop(PART)
        rows.write.option("compression", COMPRESSION).partitionBy(BUCKET).parquet(f"{path}/{folder}")
        rows = rows.drop(BUCKET)
    else:
        rows = combine(old, batch, new)
        # adaptive execution makes files of a good size out of small buckets, and splits large ones
        placed = rows.withColumn(BUCKET, bucket_of(keys, buckets)).hint("rebalance", F.col(BUCKET))
        placed.write.option("compression", COMPRESSION).partitionBy(BUCKET).parquet(f"{path}/{folder}")
    schema = rows.schema
    state = state or Version(new, buckets, keys, schema.jsonValue())
    summary = state.summary
    if summarise is not None:
        written = spark.read.schema(schema).parquet(*[f"{path}/{folder}/{BUCKET}={b}" for b in touched]) if touched else spark.createDataFrame([], schema)
        table = summarise(read_summary(spark, path), written, new, batch)
        summary = {"folder": f"{SUMMARY}/{new:012d}-{uuid.uuid4().hex}", "schema": table.schema.jsonValue()}
        table.coalesce(1).write.parquet(f"{path}/{summary['folder']}")
    after = replace(
        state, number=new, schema=schema.jsonValue(), folders={**state.folders, **{str(b): folder for b in touched}},
        sources={**state.sources, source: number}, summary=summary,
    )
    if not publish(spark, f"{path}/{VERSIONS}/{new:012d}", json.dumps(after.__dict__)):
        raise RuntimeError(f"version {new} of {path} was written by someone else; run the batch again")
    return True


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Drop versions of a merged table before the last ``keep``, and folders that none of these names.

    Folders of a batch that is being written look like leftovers, so run this between batches.
    """
    known = versions(spark, path)
    kept = [version(spark, path, n) for n in known[-keep:]]
    used = {f for v in kept for f in v.folders.values()} | {v.summary["folder"] for v in kept if v.summary}
    for n in known[:-keep]:
        delete(spark, f"{path}/{VERSIONS}/{n:012d}")
    for base in (DATA, SUMMARY):
        for name in names(spark, f"{path}/{base}"):
            if f"{base}/{name}" not in used:
                delete(spark, f"{path}/{base}/{name}")
