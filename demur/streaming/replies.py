"""Requests and replies as two streams, matched until a reply's time is up.

``attach_in_time`` is one plan for tables and for streams: an outer join within a time
interval, then one row per request. On streams the join keeps a request only until the
watermark has passed its deadline; the aggregation behind it then gives the request's row,
once, with the last successful reply or as pending. State is bounded by the requests that
are still open, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from demur.functions.columns import col
from demur.sources import tables

ASKED, REPLIED = "asked_at", "replied_at"


def attach_in_time(requests: DataFrame, replies: DataFrame, within: str, lateness: str = "0 seconds") -> DataFrame:
    """As ``matching.attach``, for replies that were given at most ``within`` after the request.

    requests: ``request_id``, ``asked_at`` and any other columns; replies: ``request_id``,
    ``replied_at``, ``seq``, ``response``, ``error``. One row per request and time of asking: its
    columns, ``response``, ``error``, ``pending``. The last successful reply counts, by ``seq``,
    then by time; without one the last failure. Replies before the request, after its deadline, without a
    time or to an unknown request are not used. A request without a time is left out, as it has no deadline.

    On streams, rows may come up to ``lateness`` behind the newest of their stream; later
    ones are dropped and counted in the query's progress.
    """
    others = [c for c in requests.columns if c not in ("request_id", ASKED)]
    left = requests.filter(col(ASKED).isNotNull()).select("request_id", ASKED, F.struct(*others).alias("_request") if others else F.lit(None).alias("_request"))
    reply = F.struct(col("error").isNull().alias("ok"), "seq", REPLIED, "response", "error")
    right = replies.filter(col(REPLIED).isNotNull()).select(col("request_id").alias("_of"), REPLIED, reply.alias("_reply"))
    # the watermark goes on top, so that it belongs to the columns that the join compares
    left, right = left.withWatermark(ASKED, lateness), right.withWatermark(REPLIED, lateness)
    in_time = (col("request_id") == col("_of")) & (col(REPLIED) >= col(ASKED)) & (col(REPLIED) <= col(ASKED) + F.expr(f"INTERVAL {within}"))
    pairs = left.join(right, in_time, "left")
    best = pairs.groupBy("request_id", ASKED).agg(F.max("_request").alias("_request"), F.max("_reply").alias("_reply"))
    return best.select(
        "request_id", ASKED, *[col(f"_request.{c}").alias(c) for c in others],
        col("_reply.response").alias("response"), col("_reply.error").alias("error"), col("_reply").isNull().alias("pending"),
    )


def _files(spark: SparkSession, source: str, schema: str | T.StructType) -> DataFrame:
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.readStream.schema(struct).option("recursiveFileLookup", True).json(source)


def stream_replies(
    spark: SparkSession, requests: str, request_schema: str | T.StructType, replies: str, reply_schema: str | T.StructType,
    target: str, checkpoint: str, within: str, lateness: str = "0 seconds",
) -> StreamingQuery:
    """Match new request files with new reply files; finished requests are appended to ``target``.

    A batch that is repeated after a crash counts once (``tables.append_batch``); read the
    result with ``tables.read_batches``. Deadlines pass by the time in the data, that of the slower
    stream: a row with an empty ``request_id`` and a time in either stream does nothing but move
    it on. Rows with a null id are not used.
    """
    both = attach_in_time(_files(spark, requests, request_schema), _files(spark, replies, reply_schema), within, lateness)

    def keep(batch: DataFrame, number: int) -> None:
        tables.append_batch(batch.filter("request_id <> ''"), target, f"{number:012d}")

    return (
        both.writeStream.outputMode("append").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
