"""Readers. A missing file or folder reads as an empty table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demur import schemas
from demur.functions.columns import col
from demur.sources import csv_splits, tables

BAD = "_bad_line"


def _struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _or_empty(read: Callable[[], DataFrame], empty: Callable[[], DataFrame]) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty()


def _raw_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    wanted = T.StructType([*_struct(schema).fields, T.StructField(BAD, T.StringType())])

    def read() -> DataFrame:
        return (
            spark.read.schema(wanted).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
            .withColumns({"_file": col("_metadata.file_path"), "_block": col("_metadata.file_block_start")})
        )

    def empty() -> DataFrame:
        fields = [*wanted.fields, T.StructField("_file", T.StringType()), T.StructField("_block", T.LongType())]
        return spark.createDataFrame([], T.StructType(fields))

    return _or_empty(read, empty)


def number_lines(df: DataFrame, log: Column | None = None) -> DataFrame:
    """``line_no``: the place of the line in its log, counted over all part files in path order.

    The rows of every split are counted first, in a pass that moves nothing but one row per
    split; running sums over these give each split its first number, and the place within
    the split is the place within its partition. No text is shuffled. ``log`` tells apart
    several logs in one read; without it everything read is one log.
    """
    at = df.withColumns({"_at": F.monotonically_increasing_id(), "_log": F.lit("") if log is None else log})
    splits = at.groupBy("_log", "_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    order = Window.partitionBy("_log").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_log", "_file", "_block", "_first", F.coalesce(F.sum("_rows").over(order), F.lit(0)).alias("_before"))
    placed = at.join(F.broadcast(starts) if _few_splits(df) else starts, ["_log", "_file", "_block"])
    return placed.withColumn("line_no", col("_before") + col("_at") - col("_first") + 1).drop("_at", "_log", "_first", "_before")


#: splits whose numbers are broadcast (about 200 bytes each)
MAX_SPLITS = 50_000


def _few_splits(df: DataFrame) -> bool:
    """The splits are known before anything is read; beyond the bound they are joined by shuffle."""
    return df.rdd.getNumPartitions() <= MAX_SPLITS


def _good(schema: str | T.StructType) -> Column:
    # Spark parses a line only if a real field is asked for, so the condition refers to one
    name = next(f for f in _struct(schema).fieldNames() if f != "line_no")
    first = F.when(F.col(f"`{name}`").isNotNull(), F.lit("x"))
    return col(BAD).isNull() | F.coalesce(first, col(BAD)).isNull()


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, numbered: bool = False) -> DataFrame:
    """One JSON object per line; a line that does not parse is left out.

    ``numbered`` fills ``line_no`` from the position in the file, for logs whose records
    do not carry one.
    """
    df = _raw_jsonl(spark, path, schema)
    df = number_lines(df) if numbered else df
    return df.filter(_good(schema)).drop(BAD, "_file", "_block")


def count_bad_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Good and bad lines per file."""
    # Spark parses a line only if a real field is asked for, so the flag refers to one
    first = col(_struct(schema).fieldNames()[0]).cast("string")
    bad = col(BAD).isNotNull() & F.coalesce(first, col(BAD)).isNotNull()
    return _raw_jsonl(spark, path, schema).groupBy("_file").agg(F.count_if(~bad).alias("good_lines"), F.count_if(bad).alias("bad_lines"))


def read_verifications(
    spark: SparkSession, root: str, schema: str | T.StructType = schemas.VERIFICATION, numbered: bool = True
) -> DataFrame:
    """All verification files of all generator folders in one read.

    A vote is known by its log and its line; ``numbered=False`` keeps the records' own
    ``line_no``, which must then be unique within a log.

    ``dataset_<generator>/<anything>verifications_<verifier>.jsonl``; generator and
    verifier come from the path, the verdict's fields become columns.
    """
    pattern = r"dataset_([^/]+)/[^/]*verifications_([^/]+)\.jsonl(/|$)"  # a file, or a folder Spark wrote
    raw = _raw_jsonl(spark, f"{root}/dataset_*/*verifications_*.jsonl", schema)
    if numbered:
        raw = number_lines(raw, F.concat_ws("/", *[F.regexp_extract("_file", pattern, k) for k in (1, 2)]))
    raw = raw.filter(_good(schema))
    tagged = raw.withColumns({
        "generator_model": F.regexp_extract("_file", pattern, 1), "verifier_model": F.regexp_extract("_file", pattern, 2)
    })
    return flatten_verdict(tagged).drop(BAD, "_file", "_block")


def read_multi_verifications(spark: SparkSession, root: str, numbered: bool = True) -> DataFrame:
    """Multi-document verification logs with the rewrite's fields as columns, ready to align.

    The question and its identity come from the original record, class and intensity from the
    perturbation's metadata, the patches and the lever from its results.
    """
    logs = read_verifications(spark, root, schemas.MULTI_VERIFICATION, numbered)
    meta, result, base = "perturbation_metadata", "perturbation_results", "original_data"
    return logs.withColumns({
        **{c: col(meta)[c] for c in ("perturbation_class", "intensity", "generation_successful", "source_qid", "source_line")},
        **{c: col(result)[c] for c in (
            "perturbed_query", "perturbed_signal_passages", "perturbed_noise_passages", "lever_selected", "implementation_reasoning",
            "intensity_achieved", "expected_rag_behavior",
        )},
        "original_query": col(base)["question"], "parsing_successful": col(result)["parsing_successful"],
    })


def flatten_verdict(df: DataFrame) -> DataFrame:
    """Fields of ``verification_response`` as columns; a record's own field of the same
    name gives way, except its parsing flag."""
    if "verification_response" not in df.columns:
        return df
    inner = [f for f in df.schema["verification_response"].dataType.fieldNames() if f != "parsing_successful"]
    return df.withColumns({f: col("verification_response")[f] for f in inner}).drop("verification_response")


_INTEGERS = ("eligibility_score", "unadjusted_factuality_score", "raf_score")


#: older and multi-document names of columns that the metrics read
_ALIASES = {"model_id": ("model", "model_name"), "model_predicted_type": ("refusal_classification",), "ground_truth_label": ("expected_behavior",)}


def _is_parquet(spark: SparkSession, path: str) -> bool:
    """Whether the first data file at a path starts as Parquet files do."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not filesystem.exists(hadoop_path):
        return False
    files = filesystem.listFiles(hadoop_path, True)
    while files.hasNext():
        file = files.next().getPath()
        if not file.getName().startswith(("_", ".")):
            stream = filesystem.open(file)
            try:
                return [stream.read() for _ in range(4)] == list(b"PAR1")
            finally:
                stream.close()
    return False


def _found(names: list[str], field: T.StructField, keys: tuple[str, ...]) -> str | None:
    """The name under which a column is there; an absent one is none, an absent key column an error."""
    present = {c.strip().lower(): c for c in names}
    name = next((present[n.lower()] for n in (field.name, *_ALIASES.get(field.name, ())) if n.lower() in present), None)
    if name is None and field.name in keys:
        raise ValueError(f"the results have no column {field.name}: {names}")
    return name


def _by_name(df: DataFrame, struct: T.StructType, keys: tuple[str, ...]) -> DataFrame:
    names = [_found(df.columns, f, keys) for f in struct]
    return df.select(*[(F.lit(None) if n is None else F.col(f"`{n}`")).cast(f.dataType).alias(f.name) for n, f in zip(names, struct, strict=True)])


def _csv_by_name(spark: SparkSession, path: str, struct: T.StructType, keys: tuple[str, ...]) -> DataFrame:
    """Columns of CSV files by the names in each file's header."""
    rows, layouts = csv_splits.read_csv(spark, path)
    columns = []
    for field in struct:
        value = F.lit(None).cast("string")
        for k, names in enumerate(layouts):
            name = _found(names, field, keys)
            if name is not None:
                value = F.when(col("layout") == k, F.get("cells", F.lit(names.index(name)))).otherwise(value)
        columns.append(F.when(value != "", value).cast(field.dataType).alias(field.name))  # an empty cell is no value
    return rows.select(*columns)


def read_results(
    spark: SparkSession, path: str, kind: str = "single", extra: str = "", fmt: str | None = None, keys: tuple[str, ...] = ("model_id",)
) -> DataFrame:
    """Evaluation results from Parquet, or from CSV with quoted multi-line texts.

    Columns are taken by the names in each file's header, whatever their order; files of
    different layouts may lie in one folder. A column that a file lacks is null, but a
    missing one of ``keys`` is an error. ``fmt`` is csv or parquet; left out, the content decides.

    A path that ``append_results`` wrote with named batches shows those that count.
    """
    schema = schemas.RESULTS_SINGLE if kind == "single" else schemas.RESULTS_MULTI
    struct = _struct(f"{schema}, {extra}" if extra else schema)

    def read() -> DataFrame:
        if fmt is None and tables.batches(spark, path):
            return _by_name(tables.read_batches(spark, path), struct, keys)
        if fmt == "parquet" or fmt is None and _is_parquet(spark, path):
            return _by_name(spark.read.parquet(path), struct, keys)
        return _csv_by_name(spark, path, struct, keys)

    df = _or_empty(read, lambda: spark.createDataFrame([], struct))
    return df.withColumns({c: col(c).cast("int") for c in _INTEGERS if c in df.columns})
