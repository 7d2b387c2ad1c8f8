"""CSV with line breaks inside quotes, read by as many tasks as a file has splits.

Whether a line lies inside quotes depends on all quotes before it, but only on whether their
number is odd. A first pass counts the quotes of every split; running parities over the
splits of a file (a row each) tell whether a split begins inside quotes. With that, each
split puts its own records together. A record that goes on past its split's end is the only
thing that splits share: the pieces of such records, one or two per split, are grouped and
joined. No text is shuffled but those pieces, and no file is read whole by one task.

Lines end with a line feed, with a carriage return before it or not. Quotes inside a quoted
field are doubled, and only quoted fields have quotes, as the usual writers have it. A file's
first line is its header.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demur.functions.columns import col
from demur.plans.shared import materialise

#: splits whose parities are listed in the plan; those of more are written to the shared folder
MAX_SPLITS = 50_000
#: splits whose parities are broadcast (about 30 bytes each), 500 TB in splits of 128 MB
MAX_BROADCAST = 4_000_000
RECORD = "_record"
WHOLE, TAIL, HEAD = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), col("_metadata.file_block_start").alias("block"), "value"
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of lines of one split: file, block, first line, last line."""
    file, block = batch.column("file").to_numpy(), batch.column("block").to_numpy()
    new = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    starts = np.concatenate([[0], new]) if len(file) else new
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(file)], strict=True):
        yield int(file[lo]), int(block[lo]), lo, hi


def _odd(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) & 1


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split whether its number of quotes is odd, and its first line if it is the file's first split."""
    current, odd, first = None, 0, None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "file": pa.array([current[0]]), "block": pa.array([current[1]]), "odd": pa.array([odd], pa.int32()), "first": pa.array([first], pa.string()),
        })

    for batch in batches:
        for file, block, lo, hi in _runs(batch):
            lines = batch.column("value").slice(lo, hi - lo)
            if (file, block) != current:
                if current is not None:
                    yield made()
                current, odd, first = (file, block), 0, lines[0].as_py() if block == 0 else None
            odd ^= int(_odd(lines).sum()) & 1
    if current is not None:
        yield made()


class _Assembler:
    """Records of one split, line by line."""

    def __init__(self, key: tuple, inside: bool, skip: bool):
        self.key, self.tail, self.skip = key, inside, skip
        self.held: list[str] = []
        self.inside = inside

    def add(self, lines: pa.Array) -> tuple[pa.Array, list[tuple[int, str]]]:
        """Whole records, and the end of a record that began in an earlier split, once it is complete."""
        odd = _odd(lines)
        after = (np.cumsum(odd) + int(self.inside)) & 1  # inside quotes after each line
        before = np.concatenate([[int(self.inside)], after[:-1]])
        single = (before == 0) & (after == 0)
        records, pieces = [lines.filter(pa.array(single))], []
        rest = np.flatnonzero(~single)
        if len(rest):
            texts, ended = lines.take(pa.array(rest)).to_pylist(), after[rest] == 0
            several = []
            for text, end in zip(texts, ended.tolist(), strict=True):
                self.held.append(text)
                if end:
                    whole = "\n".join(self.held)
                    self.held = []
                    if self.tail:
                        pieces.append((TAIL, whole))
                        self.tail = False
                    else:
                        several.append(whole)
            records.append(pa.array(several, pa.string()))
        if len(lines):
            self.inside = bool(after[-1])
        out = pa.concat_arrays(records)
        if self.skip and len(out) and not pieces:  # the header is a single line, the first of all
            out, self.skip = out.slice(1), False
        return out, pieces

    def rest(self) -> list[tuple[int, str]]:
        """What is open at the split's end: a record's beginning, or its middle."""
        return [(TAIL if self.tail else HEAD, "\n".join(self.held))] if self.inside else []


def _assemble(pieces_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Assembler | None = None

        def rows(key: tuple, kinds: list[int], texts: pa.Array) -> pa.RecordBatch:
            n = len(texts)
            file, block, layout = key
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, file)), pa.array(np.full(n, block)), pa.array(np.full(n, layout, dtype=np.int32)), pa.array(kinds, pa.int32()), texts],
                ["file", "block", "layout", "kind", RECORD],
            )

        def given(assembler: _Assembler, records: pa.Array | None, pieces: list) -> Iterator[pa.RecordBatch]:
            if pieces_only and pieces:
                yield rows(assembler.key, [k for k, _ in pieces], pa.array([t for _, t in pieces], pa.string()))
            elif not pieces_only and records is not None and len(records):
                yield rows(assembler.key, [WHOLE] * len(records), records)

        for batch in batches:
            for file, block, lo, hi in _runs(batch):
                if current is None or current.key[:2] != (file, block):
                    if current is not None:
                        yield from given(current, None, current.rest())
                    inside, layout = batch.column("inside")[lo].as_py(), batch.column("layout")[lo].as_py()
                    current = _Assembler((file, block, layout), inside, block == 0)
                yield from given(current, *current.add(batch.column("value").slice(lo, hi - lo)))
        if current is not None:
            yield from given(current, None, current.rest())

    return run


_OUT = f"file long, block long, layout int, kind int, {RECORD} string"


def _splits(lines: DataFrame) -> DataFrame:
    """Per split whether it begins and ends inside quotes, and its file's header."""
    measured = lines.mapInArrow(_measure, "file long, block long, odd int, first string")
    order = Window.partitionBy("file").orderBy("block")
    after = F.sum("odd").over(order) % 2 == 1
    return measured.select(
        "file", "block", F.first("first").over(order).alias("header"), ((F.sum("odd").over(order) - col("odd")) % 2 == 1).alias("inside"),
        after.alias("open"),
    )


def records(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """All records of the CSV files at a path as (layout, record), and the headers that the layouts number."""
    lines = _lines(spark, path)
    tasks = lines.rdd.getNumPartitions()
    if tasks > MAX_BROADCAST:
        raise ValueError(f"{tasks} splits: set spark.sql.files.maxPartitionBytes higher")
    splits = _splits(lines)
    if tasks <= MAX_SPLITS:
        found = splits.collect()  # a row per split
        layouts = sorted({r["header"] for r in found if r["header"] is not None})
        number = {h: k for k, h in enumerate(layouts)}
        kept = [(r["file"], r["block"], r["inside"], r["open"], number.get(r["header"], -1)) for r in found]
        numbered = spark.createDataFrame(kept, "file long, block long, inside boolean, open boolean, layout int")
        shared = any(r["open"] for r in found)
    else:
        splits = materialise(splits, "csv-splits")
        layouts = sorted(r["header"] for r in splits.select("header").distinct().collect() if r["header"] is not None)  # few
        number = F.array_position(F.array(*[F.lit(h) for h in layouts]), col("header")) - 1
        numbered = splits.withColumn("layout", number.cast("int")).drop("header")
        shared = bool(splits.filter("open").limit(1).count())
    # a broadcast join keeps the lines in their order, which the assembling needs
    placed = lines.join(F.broadcast(numbered), ["file", "block"])
    wanted = ("file", "block", "value", "inside", "layout")
    whole = placed.select(*wanted).mapInArrow(_assemble(False), _OUT).select("layout", RECORD)
    if not shared:
        return whole, layouts
    # records over the end of a split: in each file a head, then tails up to the one that closes it
    pieces = placed.filter("inside OR open").select(*wanted).mapInArrow(_assemble(True), _OUT)
    order = Window.partitionBy("file").orderBy("block", "kind")  # in a split its tail comes before its head
    owned = pieces.withColumn("owner", F.last(F.when(col("kind") == HEAD, col("block")), ignorenulls=True).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", "kind", RECORD)))
    joined = owned.groupBy("file", "owner").agg(F.first("layout").alias("layout"), F.array_join(F.transform(parts, lambda p: p[RECORD]), "\n").alias(RECORD))
    return whole.unionByName(joined.select("layout", RECORD)), layouts


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[list[str]]]:
    """Fields of all records as texts: ``layout`` and an array ``cells``; and per layout its column names."""
    rows, layouts = records(spark, path)
    names = [[n.strip() for n in next(csv.reader([h.rstrip("\r").lstrip("﻿")]), [])] for h in layouts]
    width = max(map(len, names), default=1) or 1
    wide = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(width)])
    text = F.when(F.endswith(RECORD, F.lit("\r")), F.expr(f"left({RECORD}, length({RECORD}) - 1)")).otherwise(col(RECORD))
    shown = rows.select("layout", text.alias(RECORD)).filter(col(RECORD) != "")
    parsed = F.from_csv(RECORD, wide.simpleString()[7:-1].replace(":", " "), {"escape": '"', "quote": '"', "multiLine": "true", "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"})
    return shown.select("layout", parsed.alias("cells")).select("layout", F.array(*[col(f"cells.c{k}") for k in range(width)]).alias("cells")), names
