"""Token ids in binary shards of independent zstandard frames.

A shard is a public seekable zstandard file: frames that decompress by themselves, then two
skippable frames. The first is ours and tells which documents lie where; the last is the
seek table of the seekable format, with compressed size, decompressed size and checksum
(low half of XXH64) of every frame. A reader of some documents reads the two tables and
then only the frames it needs.

Each task writes the shard of one range of ids under a name that no other attempt uses. Only
shards in the returned manifest count, so lost executors and repeated attempts leave
nothing but files that nobody reads.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demur.llm import words
from demur.llm.common import id_and_text, shared_folder, small_batches, stored

# fixed values of the seekable format
SKIPPABLE_INDEX, SKIPPABLE_SEEK = 0x184D2A50, 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

END_ID = 2
FRAME_BYTES = 128 * 1024
#: an id that is null is stored as this value
NO_ID = -(1 << 63)

_ENTRY = np.dtype([("doc_id", "<i8"), ("n_tokens", "<u8")])
_SEEK = np.dtype([("compressed", "<u4"), ("decompressed", "<u4"), ("checksum", "<u4")])
MANIFEST = "shard int, path string, n_docs long, n_ids long"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Documents in, frames out; holds one frame in memory. A long document spans frames."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.pending: list[bytes] = []
        self.pending_bytes = 0
        self.seek: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((NO_ID if doc_id is None else doc_id, len(ids)))
        raw = ids.astype("<u4").tobytes()
        for at in range(0, len(raw), self.frame_bytes):
            piece = raw[at: at + self.frame_bytes]
            if self.pending_bytes and self.pending_bytes + len(piece) > self.frame_bytes:
                self._flush()
            self.pending.append(piece)
            self.pending_bytes += len(piece)

    def _flush(self) -> None:
        raw = b"".join(self.pending)
        frame = self.compressor.compress(raw)
        self.out.write(frame)
        self.seek.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.pending, self.pending_bytes = [], 0

    def finish(self) -> tuple[int, int]:
        """Write the tables; number of documents and of ids."""
        if self.pending:
            self._flush()
        index = np.array(self.index, dtype=_ENTRY)
        packed = self.compressor.compress(index.tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed)) + packed)
        table = np.array(self.seek, dtype=_SEEK).tobytes()
        footer = struct.pack("<IBI", len(self.seek), CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + len(footer)) + table + footer)
        return len(index), int(index["n_tokens"].sum())


class ShardReader:
    """Random access to the documents of a shard."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        table_bytes = frames * _SEEK.itemsize
        self.seek = np.frombuffer(source.read_at(table_bytes, size - 9 - table_bytes), dtype=_SEEK)
        self.frame_at = np.concatenate([[0], np.cumsum(self.seek["compressed"], dtype=np.int64)])
        self.raw_at = np.concatenate([[0], np.cumsum(self.seek["decompressed"], dtype=np.int64)])
        index_at = int(self.frame_at[-1])
        magic, packed = struct.unpack("<II", source.read_at(8, index_at))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("the document table is missing")
        self.decompressor = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.decompressor.decompress(source.read_at(packed, index_at + 8)), dtype=_ENTRY)
        self.start = np.concatenate([[0], np.cumsum(self.index["n_tokens"], dtype=np.int64)])
        self.frames_read = 0
        self._held: tuple[int, bytes] = (-1, b"")

    def _frame(self, k: int) -> bytes:
        if self._held[0] != k:
            raw = self.decompressor.decompress(self.source.read_at(int(self.seek["compressed"][k]), int(self.frame_at[k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek["checksum"][k]:
                raise ValueError(f"frame {k} is damaged")
            self._held = (k, raw)
            self.frames_read += 1
        return self._held[1]

    def ids(self, position: int) -> np.ndarray:
        """Ids of the document at a position of the shard."""
        lo, hi = 4 * int(self.start[position]), 4 * int(self.start[position + 1])
        out = []
        while lo < hi:
            k = int(np.searchsorted(self.raw_at, lo, side="right")) - 1
            frame, first = self._frame(k), int(self.raw_at[k])
            piece = frame[lo - first: hi - first]
            out.append(piece)
            lo += len(piece)
        return np.frombuffer(b"".join(out), dtype="<u4")

    def documents(self, wanted: Iterable[int]) -> dict[int, np.ndarray]:
        """Only the requested documents, by id."""
        at = np.flatnonzero(np.isin(self.index["doc_id"], np.fromiter(wanted, dtype=np.int64)))
        return {int(self.index["doc_id"][p]): self.ids(p) for p in at}


def open_shard(path: str) -> ShardReader:
    filesystem, inner = _filesystem(path)
    return ShardReader(filesystem.open_input_file(inner))


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, frame_bytes: int = FRAME_BYTES, level: int = 3
) -> DataFrame:
    """Encode every document, write shards in ascending order of ``doc_id``, return the manifest.

    Empty and null texts give the end id alone. Rows that share an id are kept, in the
    order of their texts. An empty table gives an empty manifest.
    """
    vocabulary = vocabulary or words.vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, out, writer = words.encoder(vocabulary), None, None
        shard = TaskContext.get().partitionId()
        path = f"{folder}/tokens-{shard:06d}-{uuid.uuid4().hex}.zst"
        end = np.array([end_id], dtype="<u4")
        for batch in small_batches(batches, chars=4_000_000):
            if writer is None:
                filesystem, inner = _filesystem(folder)
                filesystem.create_dir(inner, recursive=True)
                out = filesystem.open_output_stream(f"{inner}/{path.rpartition('/')[2]}", compression=None)
                writer = ShardWriter(out, frame_bytes, level)
            ids, lengths = encoder.encode_many(batch.column("text"))
            at = 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), lengths.tolist(), strict=True):
                writer.add(doc_id, np.concatenate([ids[at: at + n], end]))
                at += n
        if writer is not None:
            n_docs, n_ids = writer.finish()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]}
            )

    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of all shards: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32``.

    A task opens whole shards but holds one frame at a time.
    """
    # one row per shard: a running sum over a table of file names
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("before", before)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = open_shard(row["path"])
                for lo in range(0, row["n_docs"], 1000):
                    some = range(lo, min(lo + 1000, row["n_docs"]))
                    yield _rows(shard, some, row["before"], with_ids)

    n = max(1, manifest.count())
    return placed.repartition(n, "shard").mapInArrow(read, schema)


def _rows(shard: ShardReader, positions: Sequence[int], before: int, with_ids: bool) -> pa.RecordBatch:
    found = [shard.ids(p) for p in positions]
    ids = [None if d == NO_ID else d for d in shard.index["doc_id"][positions.start: positions.stop].tolist()]
    columns = {
        "doc_id": pa.array(ids, pa.int64()),
        "start": pa.array(shard.start[positions.start: positions.stop] + before, pa.int64()),
        "n_tokens": pa.array([len(x) for x in found], pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64()),
    }
    if with_ids:
        columns["ids"] = pa.array([x.tolist() for x in found], pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict(columns)


def tokens_in_shared_folder(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return read_tokens(write_tokens(docs, shared_folder(spark, "tokens")))
