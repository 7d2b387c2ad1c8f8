"""Token counts for every context limit from one exact histogram of lengths.

Documents are encoded once and counted by encoded length. Suffix sums over the histogram
then answer, for any limit: how many documents are as long or longer, how many tokens they
hold, how many tokens remain when everything is cut to the limit, and every quantile of
the lengths. The histogram has one row per different length, not per document.

Suffix sums are taken within ranges of ``RANGE`` lengths and over the totals of the ranges, so
no task sorts the whole histogram: the totals are one row for every 256 lengths.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demur.llm.common import id_and_text, small_batches, stored

VOCABULARY = "byte_bpe_50k.tiktoken"
RANGE = 256

_encoders: dict[str, object] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoding(path: str):
    """One per Python worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every row; a null text has none."""
    path = vocabulary or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in small_batches(batches):
            lengths = [len(encoding.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(lengths, pa.int64())})

    return id_and_text(docs).mapInArrow(count, "doc_id long, n_tokens long")


def _counted(docs: DataFrame, vocabulary: str | None) -> DataFrame:
    path = vocabulary or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in small_batches(batches):
            lengths = [len(encoding.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            values, n = np.unique(np.array(lengths, dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"length": values, "n_docs": n.astype(np.int64)})

    return id_and_text(docs).mapInArrow(count, "length long, n_docs long")


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per encoded length that occurs, with suffix sums.

    ``length``, ``n_docs``; ``docs_at_least`` and ``tokens_at_least`` (documents of this length or
    more); ``truncated_tokens`` (all tokens when every document is cut to this length);
    ``quantile`` (share of documents of this length or less). A null or empty text has length
    0. An empty table gives no rows.
    """
    # written once, as both the ranges and the lengths need it
    histogram = stored(_counted(docs, vocabulary).groupBy("length").agg(F.sum("n_docs").alias("n_docs")), "lengths")
    histogram = histogram.withColumns({"range": F.floor(F.col("length") / RANGE), "tokens": F.col("length") * F.col("n_docs")})
    ranges = histogram.groupBy("range").agg(F.sum("n_docs").alias("range_docs"), F.sum("tokens").alias("range_tokens"))
    # one row for every RANGE lengths
    above = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))

    def before(column: str) -> Column:
        return F.coalesce(F.sum(column).over(above), F.lit(0))

    ranges = ranges.select(
        "range", before("range_docs").alias("docs_above"), before("range_tokens").alias("tokens_above"),
        F.sum("range_docs").over(every).alias("all_docs"), F.sum("range_tokens").over(every).alias("all_tokens"),
    )
    within = Window.partitionBy("range").orderBy(F.col("length").desc())
    summed = histogram.join(ranges, "range").select(
        "length", "n_docs",
        (F.col("docs_above") + F.sum("n_docs").over(within)).alias("docs_at_least"),
        (F.col("tokens_above") + F.sum("tokens").over(within)).alias("tokens_at_least"), "all_docs", "all_tokens",
    )
    return summed.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def totals_at(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Answers for any context limits: ``context``, ``n_docs_over``, ``n_tokens`` kept after cutting."""
    wanted = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    over = F.when(F.col("length") > F.col("context"), F.col("n_docs")).otherwise(0)
    kept = F.least("length", "context") * F.col("n_docs")
    # the limits asked for are few and given by the caller
    asked = histogram.select("length", "n_docs").withColumn("context", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    answered = asked.groupBy("context").agg(F.sum(over).alias("n_docs_over"), F.sum(kept).alias("n_tokens"))
    return wanted.join(answered, "context", "left").fillna(0, ["n_docs_over", "n_tokens"])


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Smallest length that at least each share of the documents does not exceed."""
    columns = [F.min(F.when(F.col("quantile") >= F.lit(float(s)) - 1e-12, F.col("length"))).alias(f"q{k}") for k, s in enumerate(shares)]
    row = histogram.agg(*columns)
    pairs = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{k}").alias("length")) for k, s in enumerate(shares)])
    return row.select(F.inline(pairs))
