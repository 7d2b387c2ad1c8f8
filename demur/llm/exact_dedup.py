"""Exact deduplication by two passes over a Bloom filter, with DataFrame functions only.

Pass one sets a bit per text and notes which bits were set more than once. Pass two looks
up the bit of every text: unless it was set again, no equal text exists, and the row passes
straight through. Only the others, whose hashes are possibly repeated, are shuffled by
their digest.

Bits are counted per task first; (bit, count) crosses to the other tasks, never the row. The
filter has one probe: a second one would send another bit of every row, to spare the shuffle
about one row in twenty.

The filter has ``BITS_PER_ROW`` bits for every row, so that about one unrepeated row in
sixteen is shuffled. What is broadcast is bounded by MAX_BITS / 8 bytes (64 MB): beyond
MAX_BITS / BITS_PER_ROW (33 million) rows the hashes are cut into ranges with a filter each,
one after the other. Digests are written sorted by hash within each task, so a pass reads
the pages of its range only, and all passes together read the digests once more.

Groups of any size are pre-aggregated per task and per salt, then looked up by (digest,
salt), so that a text holding a third of all rows is dealt to ``SALTS`` tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demur.llm.common import forget, salt, stored, with_maybe

BITS_PER_ROW = 16
MAX_BITS = 1 << 29
SALTS = 64


def _digests(docs: DataFrame, text: str, ident: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(F.col(ident).alias("doc_id"), t.alias("t"))
    return narrow.select("doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), F.xxhash64("t").alias("probe"))


def _ranges(rows: int, max_bits: int) -> tuple[int, list[tuple[int, int]]]:
    """Bits of a filter, and the ranges of the hash (both ends within) that get one each."""
    n = max(1, -(-rows * BITS_PER_ROW // max_bits))
    bits = min(max_bits, max(1 << 15, -(-rows * BITS_PER_ROW // n)))
    ends = [-(1 << 63) + (1 << 64) * k // n for k in range(n + 1)]
    return bits, [(lo, hi - 1) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def _bit(bits: int) -> Column:
    # hashed again: within a range the leading digits agree
    return F.pmod(F.xxhash64("probe"), F.lit(bits)) + 1


def repeated_bits(hashed: DataFrame, bits: int) -> DataFrame:
    """Pass one: the bits that were set more than once, as bitmaps of 4 KB."""
    again = hashed.groupBy(_bit(bits).alias("bit")).agg(F.count("*").alias("n")).filter("n > 1")
    return again.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def _looked_up(hashed: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """Pass two: adds ``maybe``, false where no equal text exists."""
    position = F.bitmap_bit_position(_bit(bits))
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(position div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (F.col("position") % 8).cast("int")) == 1, F.lit(False))
    # at most MAX_BITS / 8 bytes, whatever the input
    joined = hashed.withColumns({"bucket": F.bitmap_bucket_number(_bit(bits)), "position": position}).join(F.broadcast(filters), "bucket", "left")
    return joined.select("doc_id", "digest", "row", is_set.alias("maybe"))


def _probed(hashed: DataFrame, max_bits: int) -> DataFrame:
    bits, ranges = _ranges(hashed.count(), max_bits)
    parts = []
    for lo, hi in ranges:
        part = hashed.filter(F.col("probe").between(lo, hi)) if len(ranges) > 1 else hashed
        filters = stored(repeated_bits(part, bits), "repeated-bits")
        parts.append(stored(_looked_up(part, filters, bits), "probed"))
        forget(filters)
    return reduce(DataFrame.unionByName, parts)


def exact_dedup(docs: DataFrame, text: str = "text", ident: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """Which rows hold the same text, and which of them stays.

    One row per input row: ``doc_id``, ``keep_id`` (largest id of the equal texts),
    ``group_size``, ``kept``, ``text_sha256``. A null text counts as empty. Rows that agree
    in id and text are copies as well, and one of them is kept. A null id is smaller than
    any other. Other columns are not looked at. ``max_bits`` bounds the broadcast filter.
    """
    hashed = _digests(docs, text, ident).withColumn("row", F.monotonically_increasing_id())
    hashed = stored(hashed.sortWithinPartitions("probe"), "digests")
    probed = _probed(hashed, max_bits)
    forget(hashed)
    alone = probed.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    maybe = probed.filter("maybe").withColumn("salt", salt("row", SALTS))
    partial = maybe.groupBy("digest", "salt").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("n"))
    whole = partial.groupBy("digest").agg(
        F.max("last").alias("last"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts")
    )
    per_salt = whole.select("digest", F.explode("salts").alias("salt"), "last", "group_size")
    grouped = maybe.join(per_salt, ["digest", "salt"]).select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "digest"
    )
    return alone.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents without the copies, columns as they are.

    Rows that the broadcast filter clears pass straight through; only the others are
    shuffled and looked up.
    """
    decided = exact_dedup(docs).groupBy("doc_id", "text_sha256").agg(F.count_if("kept").alias("n_kept"), F.count("*").alias("n"))
    plan = stored(decided.filter("n_kept < n").select(_key("doc_id").alias("_key"), F.col("text_sha256").alias("_sha"), "n_kept"), "copies")
    # the row as a whole, so that no column of its can clash with ours
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), _key("doc_id").alias("_key"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("_sha"),
    )
    both = F.concat_ws(" ", "_key", "_sha")
    keyed = with_maybe(keyed, F.xxhash64(both), plan.select(F.xxhash64(both)))
    looked_up = keyed.filter("_maybe").join(plan, ["_key", "_sha"], "left")
    out = keyed.filter("not _maybe").select("_doc.*")
    out = out.unionByName(looked_up.filter("n_kept is null").select("_doc.*"))
    # rows that agree in id and text: one stays
    return out.unionByName(looked_up.filter("n_kept > 0").dropDuplicates(["_key", "_sha"]).select("_doc.*"))


def _key(ident: str) -> Column:
    return F.coalesce(F.col(ident).cast("string"), F.lit(""))
