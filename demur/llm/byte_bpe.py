"""Byte-level BPE ids of whole texts and back, long texts in overlapping chunks.

A text is cut by a pattern into pre-tokens, each of which is encoded by itself. The pattern
looks at what follows, not at what came before, so two scans of a text that have a boundary
at the same place go on alike from there. Texts of more than ``CHUNK`` characters are cut
into chunks that overlap by ``OVERLAP``; chunks are dealt out over the tasks and scanned side
by side. The scan of the one before and the scan of the next are stitched at the first
boundary that both have inside the overlap, at least ``MARGIN`` characters before the end of
the first one, whose last pre-tokens may have been cut off. Where there is none (a pre-token
longer than the overlap, say), the chunks on both sides are joined to one piece, which is
scanned anew. The pieces between the stitches are then encoded side by side, too.

Ids of a pre-token are merged by the tiktoken library and held in a bounded cache. Decoding
concatenates the bytes of the ids. Texts of one chunk are encoded where they are read: no
shuffle. Checksums over a long text read its pieces one after the other, in order.

Null texts count as empty: no ids. One row per row; repeated rows and null ids are rows of
their own. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demur.llm.common import id_and_text, release_memory, small_batches, stored
from demur.llm.words import vocabulary_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK, OVERLAP = 65_536, 1_024
#: a pre-token that ends this far before a chunk's end was not cut off: the pattern's fixed
#: strings have three characters at most, its runs end before a character of another kind
MARGIN = 8
#: pre-tokens in a worker's cache, at about 150 bytes each
MAX_PIECES = 400_000

_coders: dict[tuple[str, str], Coder] = {}


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def coder(path: str, pattern: str) -> Coder:
    """One per Python worker, which keeps its cache from task to task."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


class Coder:
    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.ranks = ranks
        self.held: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        raw = piece.encode()
        rank = self.ranks.get(raw)
        ids = array("I", [rank] if rank is not None else self.encoding._core_bpe.encode_single_piece(raw)).tobytes()
        if len(piece) <= 32:
            if len(self.held) >= MAX_PIECES:
                self.held.clear()
            self.held[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, own = self.held.get, self._ids
        return b"".join([get(p) or own(p) for p in self.pattern.findall(text)])

    def encode_between(self, text: str, begin: int, end: int) -> bytes:
        """Ids of the pre-tokens from one boundary to another; the pattern may look beyond the last."""
        pieces = []
        for m in self.pattern.finditer(text, begin):
            if m.start() >= end:
                break
            pieces.append(m.group())
        get, own = self.held.get, self._ids
        return b"".join([get(p) or own(p) for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes
        return b"".join([table[k] for k in np.frombuffer(ids, dtype="<u4").tolist()])

    def boundaries(self, text: str) -> list[int]:
        """Where pre-tokens end."""
        return [m.end() for m in self.pattern.finditer(text)]


def chunks_of(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """Number, start and characters; all but the last go on into the next one's first ``overlap``."""
    for k, start in enumerate(range(0, max(len(text), 1), chunk)):
        yield k, start, text[start: start + chunk + overlap]


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = -1 - (TaskContext.get().partitionId() << 40)
        for batch in small_batches(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = list(chunks_of(text, chunk, overlap))
                for at in range(0, len(parts), 32):
                    some = parts[at: at + 32]
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array([row] * len(some), pa.int64()), "doc_id": pa.array([doc_id] * len(some), pa.int64()),
                        "k": pa.array([p[0] for p in some], pa.int32()), "start": pa.array([p[1] for p in some], pa.int64()),
                        "chars": pa.array([p[2] for p in some], pa.string()), "last": pa.array([p[0] == parts[-1][0] for p in some]),
                    })
                row -= 1
        release_memory()

    return run


def _scanned(path: str, pattern: str, chunk: int, overlap: int):
    """Boundaries in a chunk's first and last ``overlap`` characters, as places in the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = coder(path, pattern)
        for batch in small_batches(batches, "chars"):
            heads, tails = [], []
            for start, chars, last in zip(*(batch.column(c).to_pylist() for c in ("start", "chars", "last")), strict=True):
                ends = scan.boundaries(chars)
                heads.append([start] + [start + e for e in ends if e <= overlap] if start else [])
                tails.append([] if last else [start + e for e in ends if chunk <= e <= len(chars) - MARGIN])
            head, tail = (pa.array(x, pa.list_(pa.int64())) for x in (heads, tails))
            yield pa.RecordBatch.from_arrays([*batch.columns, head, tail], [*batch.schema.names, "head", "tail"])
        release_memory()

    return run


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path, pattern)
        row = TaskContext.get().partitionId() << 40
        for batch in small_batches(batches):
            ids = [encode.encode(t) for t in batch.column("text").to_pylist()]
            rows = pa.array(np.arange(row, row + len(ids)))
            row += len(ids)
            parts = pa.array(np.zeros(len(ids), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id"), parts, pa.array(ids, pa.binary())], ["row", "doc_id", "part", "ids"])
        release_memory()

    return run


ENCODED = "row long, doc_id long, part int, ids binary"


def _encoded_pieces(path: str, pattern: str, chunk: int):
    """Pieces from the chunks of a run, which come in order: from the stitch before it to the one after it.

    Chunks that could not be stitched follow each other in a run and are joined without their
    overlap. A run is one chunk but where a pre-token is longer than the overlap.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path, pattern)
        held: list[str] = []
        of, begin = None, 0
        for batch in small_batches(batches, "chars", chars=500_000):
            out: list[tuple] = []
            columns = ("row", "doc_id", "part", "start", "chars", "since", "until")
            for row, doc_id, part, start, chars, since, until in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if (row, part) != of:
                    held, of, begin, origin = [], (row, part), since, start
                if until is None:  # goes on in the next chunk
                    held.append(chars[:chunk])
                    continue
                out.append((row, doc_id, part, encode.encode_between("".join([*held, chars]), begin - origin, until - origin)))
                held = []
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            made = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, types, strict=True)], ["row", "doc_id", "part", "ids"])
        release_memory()

    return run


def encode_long(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Texts by overlapping chunks: ``row, doc_id, part, ids``, a row per piece."""
    if chunk <= overlap + MARGIN:
        raise ValueError("chunks must be longer than their overlap")
    columns = "row long, doc_id long, k int, start long, chars string, last boolean"
    dealt = id_and_text(docs).mapInArrow(_cut(chunk, overlap), columns).repartition("row", "k")
    scan = _scanned(path, pattern, chunk, overlap)
    scanned = stored(dealt.mapInArrow(scan, columns + ", head array<long>, tail array<long>"), "chunks")
    # stitches are found on the places alone, without the texts
    text = Window.partitionBy("row").orderBy("k")
    stitch = F.array_min(F.array_intersect("tail", F.lead("head").over(text)))
    stitched = scanned.select("row", "k", stitch.alias("until")).withColumn("since", F.lag("until").over(text))
    first = (F.col("k") == 0) | F.col("since").isNotNull()
    runs = stitched.select("row", "k", "until", F.coalesce("since", F.lit(0)).alias("since"), F.count_if(first).over(text).cast("int").alias("part"))
    pieces = scanned.drop("head", "tail").join(runs, ["row", "k"]).withColumn(
        "until", F.when(F.col("last"), F.col("start") + F.length("chars")).otherwise(F.col("until"))
    )
    ordered = pieces.repartition("row", "part").sortWithinPartitions("row", "part", "k")
    return ordered.mapInArrow(_encoded_pieces(path, pattern, chunk), ENCODED)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``row`` (a number of the input row), ``doc_id, part, ids``: the ids of a row's parts in order are its ids.

    Ids are little-endian unsigned 32-bit integers. Only texts of more than ``chunk``
    characters, whose rows have negative numbers, have several parts.
    """
    path, pattern = path or vocabulary_path(VOCABULARY), pattern or default_pattern()
    plain = id_and_text(docs)
    short = plain.filter(F.length("text") <= chunk).mapInArrow(_encoded(path, pattern), ENCODED)
    return short.unionByName(encode_long(plain.filter(F.length("text") > chunk), path, pattern, chunk, overlap))


def _decoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = coder(path, pattern)
        for batch in small_batches(batches, "ids"):
            raw = pa.array([decode.decode(ids) for ids in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], raw], ["row", "doc_id", "part", "bytes"])
        release_memory()

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``row, doc_id, part, bytes`` of what ``encode`` gives. A part may end inside a character's bytes."""
    decoded = _decoded(path or vocabulary_path(VOCABULARY), default_pattern())
    return encoded.select("row", "doc_id", "part", "ids").mapInArrow(decoded, "row long, doc_id long, part int, bytes binary")


def _digests(path: str):
    """Of parts in order: number of ids, checksum of the ids and of the bytes they stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = coder(path, default_pattern())
        current, doc, n, of_ids, of_bytes = None, None, 0, hashlib.sha256(), hashlib.sha256()
        out: list[tuple] = []
        names, types = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()]

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in small_batches(batches, "ids"):
            for row, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "ids")), strict=True):
                if row != current:
                    if current is not None:
                        out.append((doc, n, of_ids.hexdigest(), of_bytes.hexdigest()))
                    current, doc, n, of_ids, of_bytes = row, doc_id, 0, hashlib.sha256(), hashlib.sha256()
                n += len(ids) // 4
                of_ids.update(ids)
                of_bytes.update(decode.decode(ids))
            yield made()
        if current is not None:
            out.append((doc, n, of_ids.hexdigest(), of_bytes.hexdigest()))
            yield made()
        release_memory()

    return run


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, a row per input row."""
    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    each = _digests(path or vocabulary_path(VOCABULARY))
    whole = encoded.filter("row >= 0").mapInArrow(each, columns)
    parts = encoded.filter("row < 0").repartition("row").sortWithinPartitions("row", "part").mapInArrow(each, columns)
    return whole.unionByName(parts)
