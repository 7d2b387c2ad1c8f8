"""Removal of byte strings that an earlier document has, by a column-wise sort of segments with
common prefixes, as in the construction of a collection's Burrows-Wheeler transform.

Every window of ``WINDOW`` bytes has an anchor: the leftmost of its ``ANCHOR``-byte strings
with the smallest hash. Consecutive windows with the same anchor form a segment of at most
2 * WINDOW - ANCHOR bytes. Equal windows have equal anchors at equal places, so segments are
dealt out by the hash of their anchor, and all equal windows meet in one task, in the same
column once segments are aligned at their anchors.

A task sorts its segments column by column, from right to left: each round reads one symbol
per segment. Sorting the symbols before the suffixes of the last round stably gives the order
of the new suffixes; their common prefixes follow from range minima of the old ones. Symbols
are then dropped; no transform is kept. The columns of a chunk are in one file, read in order;
order and prefixes are in memory, as is a row for each segment of the part. Suffixes of different columns need no common
order, as no equal windows lie in different columns. After each round that inserts the first
byte of windows, runs of common prefixes of WINDOW or more are the equal windows, and those
of documents after the smallest in the run are marked.

Segments that occur several times in a batch of documents are sent once, for the smallest
document that has them; later documents are marked at once.

An anchor can be in very many different segments: text that many documents share, beside
their own. Segments per anchor are counted first. Those of anchors with more than ``HOT``
segments are cut into their windows, which are dealt out by a hash of all their bytes, each
for the smallest document of its batch. So only equal windows meet, one per batch.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.llm.common import id_and_text, release_memory, small_batches, stored, with_maybe
from demur.llm.shingling import mixed

WINDOW, ANCHOR = 50, 16
#: bytes of text for each part that segments are dealt to, and parts at least
PART_BYTES, MIN_PARTS = 6_000_000, 48
#: segments whose columns are built together; whole anchors, none of which has more than 2 * HOT
CHUNK = 200_000
#: segments of an anchor above which its windows are dealt out instead
HOT = 50_000
#: anchors are counted by so many of their hash's values
HOT_SLOTS = 1 << 22
#: windows of hot anchors for each further part
PART_WINDOWS = 1_000_000
#: text whose segments are sent together
SEND_CHARS = 2_000_000
ABSENT = 0xFF  # in no UTF-8 text
#: documents without an id come before all others
NO_ID = -(1 << 63)

_LEFT = WINDOW - ANCHOR  # the anchor starts at most so many bytes after its window
COLUMNS = _LEFT + WINDOW
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _anchor_hashes(raw: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """Hash of the ``size`` (a power of two) bytes from every place on."""
    h, base, span = _TABLE[raw], _BASE, 1
    with np.errstate(over="ignore"):
        while span < size:
            h = h[:-span] * base + h[span:]
            base, span = base * base, 2 * span
    return mixed(h)


def _window_minima(h: np.ndarray, width: int) -> np.ndarray:
    out, span = h, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(out) - (width - span)], out[width - span:])
    return out


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(HOT_SLOTS - 1)).astype(np.int64)


def _cut(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window and number of windows of every segment, hashes from every place on and their minima."""
    h = _anchor_hashes(raw)
    smallest = _window_minima(h, _LEFT + 1)
    n = len(smallest)
    # a window is inside a text if no text ends within it
    inside = np.ones(n + WINDOW, dtype=np.int32)
    crossing = np.zeros(n + WINDOW, dtype=np.int32)
    for shift, sign in ((WINDOW - 1, 1), (0, -1)):
        at = ends - shift
        np.add.at(crossing, np.clip(at[at < n + WINDOW], 0, None), sign)
    inside = (np.cumsum(crossing)[:n] == 0)
    new = np.ones(n, dtype=bool)
    new[1:] = (smallest[1:] != smallest[:-1]) | (h[: n - 1] == smallest[:-1]) | ~inside[:-1]
    new &= inside
    first = np.flatnonzero(new)
    stop = np.flatnonzero(np.append(new | ~inside, True))
    windows = stop[np.searchsorted(stop, first, side="right")] - first
    return first, windows, h, smallest


def segments(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, place of the anchor and its slot of every segment."""
    nothing = np.zeros(0, dtype=np.int64)
    if len(raw) < WINDOW:
        return nothing, nothing, nothing, nothing
    first, windows, h, smallest = _cut(raw, ends)
    anchor = np.empty(len(first), dtype=np.int64)
    around = np.lib.stride_tricks.sliding_window_view(h, _LEFT + 1)
    for lo in range(0, len(first), 50_000):
        some = first[lo: lo + 50_000]
        anchor[lo: lo + 50_000] = some + (around[some] == smallest[some, None]).argmax(axis=1)
    return first, windows, anchor, _slots(smallest[first])


def aligned(raw: np.ndarray, first: np.ndarray, windows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Segments as rows with the anchor in one column, ABSENT around them."""
    edge = np.full(COLUMNS, ABSENT, dtype=np.uint8)
    padded = np.concatenate([edge, raw, edge])
    rows = np.lib.stride_tricks.sliding_window_view(padded, COLUMNS)[anchor - _LEFT + COLUMNS]
    start = _LEFT - (anchor - first)
    column = np.arange(COLUMNS)
    rows[(column < start[:, None]) | (column >= (start + windows + WINDOW - 1)[:, None])] = ABSENT
    return rows


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), dtype=np.uint64)
    words = rows.view(np.uint32)  # COLUMNS is a multiple of four
    with np.errstate(over="ignore"):
        for k in range(words.shape[1]):
            out = out * _BASE + words[:, k] + np.uint64(1)
    return mixed(out)


def equal_windows(columns: Iterator[np.ndarray], docs: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Rows whose window in a column also starts in a smaller document, for every column of windows.

    ``columns`` gives the symbols of all segments from the last column to the first.
    """
    m = len(docs)
    order = np.arange(m)
    common = np.zeros(m, dtype=np.uint8)
    for column in range(COLUMNS - 1, -1, -1):
        symbols = next(columns)[order]
        turn = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[turn]
        same = np.zeros(m, dtype=bool)
        same[1:] = sorted_symbols[1:] == sorted_symbols[:-1]
        # between a suffix and the one before it with the same first symbol; one more value,
        # so that the range of a pair that ends with the last suffix has its end as well
        least = np.zeros(m, dtype=np.uint8)
        least[1:] = np.minimum.reduceat(np.append(common, np.uint8(ABSENT)), turn + 1)[:-1]
        common = np.where(same, least + np.uint8(1), np.uint8(0)).astype(np.uint8)
        order = order[turn]
        if column <= _LEFT:
            # only runs of two or more can hold a smaller document
            joined = common >= WINDOW
            edges = joined.copy()
            edges[:-1] |= joined[1:]
            at = np.flatnonzero(edges)
            if len(at):
                rows = order[at]
                heads = np.flatnonzero(~joined[at])
                smallest = np.repeat(np.minimum.reduceat(docs[rows], heads), np.diff(np.append(heads, len(at))))
                hit = (smallest < docs[rows]) & (column >= starts[rows]) & (column < starts[rows] + windows[rows])
                if hit.any():
                    yield rows[hit], column


def _planes(values: np.ndarray, dtype: str) -> np.ndarray:
    """First all lowest bytes, then all second ones, and so on; compresses better."""
    kind = np.dtype(dtype)
    return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T)


def _whole(planes: np.ndarray, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


class _Parts:
    """One batch's segments for one part, as sent between tasks."""

    @staticmethod
    def pack(rows, start, windows, doc_ids, marks, owner, at) -> bytes:
        """rows etc. per segment; owner and at (segment, document in the batch, place) per occurrence."""
        body = rows[rows != ABSENT]
        used, document = np.unique(owner[1], return_inverse=True)
        arrays = (
            start.astype(np.uint8), windows.astype(np.uint8), _planes(np.diff(doc_ids[used], prepend=0), "<i8"), marks[used].astype("<u4"),
            np.diff(owner[0], prepend=0).astype(np.uint8), _planes(np.diff(document, prepend=0), "<i4"), _planes(np.diff(at, prepend=0), "<i4"),
        )
        head = np.array([len(rows), len(used), len(document), len(body)], dtype="<u8")
        raw = b"".join([head.tobytes(), body.tobytes(), *[a.tobytes() for a in arrays]])
        return zstandard.ZstdCompressor(level=6).compress(raw)

    def __init__(self, packed: bytes):
        raw = zstandard.decompress(packed)
        n, used, occurrences, size = np.frombuffer(raw, dtype="<u8", count=4).tolist()
        at = 32

        def take(dtype, count):
            nonlocal at
            out = np.frombuffer(raw, dtype=dtype, count=count, offset=at)
            at += out.nbytes
            return out

        self.body = take(np.uint8, size)
        self.start, self.windows = take(np.uint8, n), take(np.uint8, n)
        self.doc_ids, self.marks = np.cumsum(_whole(take(np.uint8, 8 * used), "<i8")), take("<u4", used)
        self.segment = np.cumsum(take(np.uint8, occurrences), dtype=np.int32)  # each follows the one before, or is the same
        self.document = np.cumsum(_whole(take(np.uint8, 4 * occurrences), "<i4"), dtype=np.int32)
        self.at = np.cumsum(_whole(take(np.uint8, 4 * occurrences), "<i4"), dtype=np.int32)
        # occurrences of a segment are in documents of one id
        self.doc_of = np.zeros(n, dtype=np.int64)
        self.doc_of[self.segment] = self.doc_ids[self.document]

    def _ends(self) -> np.ndarray:
        return np.cumsum(self.windows.astype(np.int64) + (WINDOW - 1))

    def anchors(self) -> np.ndarray:
        """Hash of each segment's anchor."""
        at = self._ends() - (self.windows.astype(np.int64) + (WINDOW - 1)) + (_LEFT - self.start.astype(np.int64))
        return _anchor_hashes_at(self.body, at) if len(at) else np.zeros(0, dtype=np.uint64)

    def rows(self, wanted: np.ndarray | None = None) -> np.ndarray:
        """The wanted segments as rows, or all. Gives the bytes back, so this can be called once."""
        wanted = np.ones(len(self.start), dtype=bool) if wanted is None else wanted
        length = self.windows.astype(np.int64) + (WINDOW - 1)
        body = self.body[np.repeat(wanted, length)]
        self.body = None
        start, length = self.start[wanted], length[wanted]
        out = np.full((len(start), COLUMNS), ABSENT, dtype=np.uint8)
        column = np.arange(COLUMNS)
        out[(column >= start[:, None]) & (column < (start + length)[:, None])] = body
        return out


def _intervals(documents: np.ndarray, places: np.ndarray, count: int) -> Iterator[tuple[int, bytes]]:
    """Marked windows as intervals of removed bytes for each document."""
    order = np.lexsort((places, documents))
    documents, places = documents[order], places[order]
    new = np.ones(len(places), dtype=bool)
    new[1:] = (documents[1:] != documents[:-1]) | (places[1:] > places[:-1] + WINDOW)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(places)) - 1
    pairs = np.stack([places[heads], places[tails] + WINDOW], axis=1).astype("<u4")
    owner = documents[heads]
    at = np.searchsorted(owner, np.arange(count + 1))
    for d in np.unique(owner).tolist():
        yield d, pairs[at[d]: at[d + 1]].tobytes()


def _window_keys(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two hashes (columns) of the bytes of the windows."""
    out = np.empty((len(at), 2), dtype=np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)
    padded = np.zeros((50_000, -(-WINDOW // 8) * 8), dtype=np.uint8)
    for lo in range(0, len(at), len(padded)):
        some = at[lo: lo + len(padded)]
        padded[: len(some), :WINDOW] = view[some]
        words = padded[: len(some)].view(np.uint64)
        for k, h in enumerate((_BASE, ~_BASE)):
            h = np.full(len(some), h)
            with np.errstate(over="ignore"):
                for word in words.T:
                    h = mixed(h * _BASE + word)
            out[lo: lo + len(some), k] = h
    return out


class _Windows:
    """One batch's windows of hot anchors for one part, as sent between tasks."""

    @staticmethod
    def pack(keys, doc_ids, marks, owner, at) -> bytes:
        """keys per window; owner and at (window, document in the batch, place) per occurrence."""
        used, document = np.unique(owner[1], return_inverse=True)
        head = np.array([len(keys), len(used), len(document)], dtype="<u8")
        arrays = (
            keys.astype("<u8"), doc_ids[used].astype("<i8"), marks[used].astype("<u4"),
            owner[0].astype("<u4"), document.astype("<u4"), at.astype("<u4"),
        )
        return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *[a.tobytes() for a in arrays]]))

    def __init__(self, packed: bytes):
        raw = zstandard.decompress(packed)
        n, used, occurrences = np.frombuffer(raw, dtype="<u8", count=3).tolist()
        start = 24

        def take(dtype, count):
            nonlocal start
            out = np.frombuffer(raw, dtype=dtype, count=count, offset=start)
            start += out.nbytes
            return out

        self.keys = take("<u8", 2 * n).reshape(-1, 2)
        self.doc_ids, self.marks = take("<i8", used), take("<u4", used)
        self.window, self.document, self.at = (take("<u4", occurrences) for _ in range(3))
        # occurrences of a window are in documents of one id
        self.doc_of = np.zeros(n, dtype=np.int64)
        self.doc_of[self.window] = self.doc_ids[self.document]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order in which equal keys follow each other, and where each one begins."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    return order, np.flatnonzero(new)


def _smallest(docs: np.ndarray, order: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key its run and the smallest document in it."""
    run = np.empty(len(order), dtype=np.int64)
    run[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    return run, np.minimum.reduceat(docs[order], heads)[run]


def _same_windows(packs: list[_Windows]) -> Iterator[pa.RecordBatch]:
    """Windows of one part that a smaller document has."""
    doc_of = np.concatenate([p.doc_of for p in packs])
    _, smallest = _smallest(doc_of, *_runs(np.concatenate([p.keys for p in packs])))
    later = doc_of > smallest
    base = np.cumsum([0, *[len(p.keys) for p in packs]])
    for p, lo, hi in zip(packs, base[:-1].tolist(), base[1:].tolist(), strict=True):
        hit = later[lo:hi][p.window]
        if hit.any():
            found = _intervals(p.document[hit].astype(np.int64), p.at[hit].astype(np.int64), len(p.doc_ids))
            yield _mark_rows([(int(p.doc_ids[d]), int(p.marks[d]), x) for d, x in found])


@dataclass(frozen=True)
class Dealing:
    """Parts of segments, slots of the hot anchors, further parts of their windows."""

    parts: int
    hot: np.ndarray | None = None
    more: int = 0


def hot_anchors(texts: DataFrame, total: int, parts: int, hot: int = HOT) -> Dealing:
    """Counts the segments of every anchor; each anchor with more than 2 * hot is found.

    A task leaves out what is below its share of ``hot`` by bytes of text. All that is left
    out of one anchor's count is ``hot`` at most, and few rows are returned. Anchors share
    slots, so one with fewer segments can be found as well, which changes no result.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, read = np.zeros(HOT_SLOTS, dtype=np.uint32), 0
        for batch in small_batches(batches, chars=SEND_CHARS):
            raw, bounds = _bytes(batch)
            read += len(raw)
            if len(raw) >= WINDOW:
                first, _, _, smallest = _cut(raw, bounds[1:])
                slot, n = np.unique(_slots(smallest[first]), return_counts=True)
                counts[slot] += n.astype(np.uint32)
        slot = np.flatnonzero(counts > hot * (read / max(total, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(counts[slot].astype(np.int64))], names=["slot", "n"])
        del counts
        release_memory()

    found = texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") > hot).collect()
    if not found:
        return Dealing(parts)
    is_hot = np.zeros(HOT_SLOTS, dtype=bool)
    is_hot[[r["slot"] for r in found]] = True
    windows = (_LEFT + 1) * sum(r["n"] + hot for r in found)
    return Dealing(parts, np.packbits(is_hot), max(1, -(-windows // PART_WINDOWS)))


SENT = "part int, doc_id long, mark long, packed binary"


def _sender(dealing: Dealing):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, chars=SEND_CHARS):
            yield from _sent(batch, dealing)

    return send


def _bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one, and where each begins and the last ends."""
    texts = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]: offsets[-1]]
    return raw, offsets - offsets[0]


def _ramps(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n numbers from each first one on."""
    return np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _sent(batch: pa.RecordBatch, dealing: Dealing) -> Iterator[pa.RecordBatch]:
    parts = dealing.parts
    doc_ids = np.array([NO_ID if d is None else d for d in batch.column("doc_id").to_pylist()], dtype=np.int64)
    raw, bounds = _bytes(batch)
    marks = np.array([_mark(t) for t in batch.column("text").cast(pa.large_binary()).to_pylist()], dtype=np.int64)
    first, windows, anchor, slot = segments(raw, bounds[1:])
    rows = aligned(raw, first, windows, anchor)
    owner = np.searchsorted(bounds, first, side="right") - 1
    out: list[tuple[int, int, int, bytes]] = []
    if len(first):
        # equal segments: sent for the smallest document, marked at once in the others
        _, representative, group = np.unique(_row_hashes(rows), return_index=True, return_inverse=True)
        different = (rows != rows[representative[group]]).any(axis=1)
        group[different] = len(representative) + np.arange(int(different.sum()))
        smallest = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, group, doc_ids[owner])
        later = doc_ids[owner] > smallest[group]
        if later.any():
            n = windows[later]
            places = np.repeat(first[later] - bounds[owner[later]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            for d, intervals in _intervals(np.repeat(owner[later], n), places, len(doc_ids)):
                out.append((d % parts, int(doc_ids[d]), int(marks[d]), intervals))
        keep = np.flatnonzero(~later)
        if dealing.hot is not None:
            hot = np.unpackbits(dealing.hot)[slot[keep]] > 0
            out.extend(_sent_windows(raw, bounds, doc_ids, marks, first[keep[hot]], windows[keep[hot]], dealing))
            keep = keep[~hot]
        head = np.full(group.max() + 1, -1)
        head[group[keep][::-1]] = keep[::-1]  # the first occurrence stands for the segment
        hashed = _anchor_hashes_at(raw, anchor[head[head >= 0]])
        part_of_group = np.full(len(head), -1)
        part_of_group[head >= 0] = (hashed % np.uint64(parts)).astype(np.int64)
        by_part = part_of_group[group[keep]]
        sort = np.lexsort((keep, head[group[keep]], by_part))
        keep, by_part = keep[sort], by_part[sort]
        cuts = np.flatnonzero(np.diff(by_part, prepend=-1))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keep)], strict=False):
            own = keep[lo:hi]
            heads, segment = np.unique(head[group[own]], return_inverse=True)
            packed = _Parts.pack(
                rows[heads], _LEFT - (anchor[heads] - first[heads]), windows[heads], doc_ids, marks,
                (segment, owner[own]), first[own] - bounds[owner[own]],
            )
            out.append((int(by_part[lo]), None, None, packed))
    if out:
        part, doc_id, mark, packed = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(mark, pa.int64()), pa.array(packed, pa.binary())],
            names=["part", "doc_id", "mark", "packed"],
        )


def _sent_windows(raw, bounds, doc_ids, marks, first, windows, dealing: Dealing) -> Iterator[tuple[int, int | None, int | None, bytes]]:
    """Windows of these segments for the smallest document that has them; later ones are marked at once."""
    if not len(first):
        return
    at = _ramps(first, windows)
    owner = np.searchsorted(bounds, at, side="right") - 1
    place = at - bounds[owner]
    keys = _window_keys(raw, at)
    order, heads = _runs(keys)
    run, smallest = _smallest(doc_ids[owner], order, heads)
    later = doc_ids[owner] > smallest
    if later.any():
        for d, intervals in _intervals(owner[later], place[later], len(doc_ids)):
            yield d % dealing.parts, int(doc_ids[d]), int(marks[d]), intervals
    keep = np.flatnonzero(~later)
    part = dealing.parts + (keys[keep, 0] % np.uint64(dealing.more)).astype(np.int64)
    sort = np.lexsort((keep, part))
    keep, part = keep[sort], part[sort]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keep)], strict=True):
        own = keep[lo:hi]
        _, one, window = np.unique(run[own], return_index=True, return_inverse=True)
        yield int(part[lo]), None, None, _Windows.pack(keys[own[one]], doc_ids, marks, (window, owner[own]), place[own])


def _anchor_hashes_at(raw: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Hash of the anchors alone, from their bytes."""
    view = np.lib.stride_tricks.sliding_window_view(raw, ANCHOR)[anchor]
    return _anchor_keys(np.ascontiguousarray(view))


def _anchor_keys(anchors: np.ndarray) -> np.ndarray:
    words = anchors.view(np.uint64)
    with np.errstate(over="ignore"):
        return mixed(words[:, 0] * _BASE + mixed(words[:, 1]))


def _mark(text: bytes) -> int:
    """Tells apart rows that share an id."""
    return xxhash.xxh32_intdigest(text)


MARKS = "doc_id long, mark long, intervals binary"


def _mark_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "mark", "intervals"]
    )


def _marker(parts: int):
    """Parts from ``parts`` on hold windows, the others segments."""
    return lambda batches: _marked(batches, parts)


def _marked(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Marks of one part after the other; rows come sorted by part."""
    current, held = None, []
    for batch in small_batches(batches, "packed", chars=4_000_000):  # no second copy of many rows at once
        done = []
        for part, doc_id, mark, packed in zip(*[batch.column(c).to_pylist() for c in ("part", "doc_id", "mark", "packed")], strict=True):
            if mark is not None:
                done.append((doc_id, mark, packed))
                continue
            if part != current:
                if held:
                    yield from (_compared if current < parts else _same_windows)(held)
                    release_memory()
                current, held = part, []
            held.append((_Parts if part < parts else _Windows)(packed))
        if done:
            yield _mark_rows(done)
    if held:
        yield from (_compared if current < parts else _same_windows)(held)
    del held
    release_memory()


def _compared(parts: list[_Parts]) -> Iterator[pa.RecordBatch]:
    """Equal windows among the segments of one part.

    Segments whose anchor only one document has are left out before any row is built.
    """
    doc_of = np.concatenate([p.doc_of for p in parts])
    anchors = np.concatenate([p.anchors() for p in parts])
    order = np.argsort(anchors, kind="stable").astype(np.int32)
    heads = np.flatnonzero(np.append(True, np.diff(anchors[order]) != 0)) if len(order) else np.zeros(0, dtype=np.int64)
    del anchors
    group = np.diff(np.append(heads, len(order)))
    several = np.minimum.reduceat(doc_of[order], heads) != np.maximum.reduceat(doc_of[order], heads) if len(heads) else np.zeros(0, dtype=bool)
    order = order[np.repeat(several, group)]
    ends = np.cumsum(group[several])
    wanted = np.zeros(len(doc_of), dtype=bool)
    wanted[order] = True
    number = np.cumsum(wanted, dtype=np.int32) - 1  # of a segment among the wanted ones
    order = number[order]
    rows = np.empty((int(wanted.sum()), COLUMNS), dtype=np.uint8)
    base = np.cumsum([0, *[len(p.start) for p in parts]])
    segment, document, at = [], [], []
    document_base = np.cumsum([0, *[len(p.doc_ids) for p in parts]])
    for p, lo, hi, docs in zip(parts, base[:-1].tolist(), base[1:].tolist(), document_base[:-1].tolist(), strict=True):
        own = wanted[lo:hi]
        if own.any():
            first = int(number[lo + int(own.argmax())])
            rows[first: first + int(own.sum())] = p.rows(own)
            seen = own[p.segment]
            segment.append(number[lo + p.segment[seen]])
            document.append(p.document[seen] + np.int32(docs))
            at.append(p.at[seen])
        p.body = p.segment = p.document = p.at = None
    if not len(rows):
        return
    segment, document, at = np.concatenate(segment), np.concatenate(document), np.concatenate(at)
    start = np.concatenate([p.start for p in parts])[wanted].astype(np.int64)
    windows = np.concatenate([p.windows for p in parts])[wanted].astype(np.int64)
    doc_ids, marks = np.concatenate([p.doc_ids for p in parts]), np.concatenate([p.marks for p in parts])
    doc_of = doc_of[wanted]
    parts.clear()
    by_segment = np.argsort(segment, kind="stable").astype(np.int32)
    first_of = np.searchsorted(segment[by_segment], np.arange(len(rows) + 1))
    lo = 0
    while lo < len(order):
        stop = np.searchsorted(ends, lo + CHUNK, side="right")
        hi = int(ends[min(max(stop - 1, np.searchsorted(ends, lo, side="right")), len(ends) - 1)])
        chunk = order[lo:hi]
        lo = hi
        found_rows, found_columns = [], []
        with tempfile.TemporaryFile() as file:
            for column in range(COLUMNS - 1, -1, -1):  # columns from the last to the first
                file.write(rows[chunk, column].tobytes())
            file.seek(0)
            columns = (np.frombuffer(file.read(len(chunk)), dtype=np.uint8) for _ in range(COLUMNS))
            for r, column in equal_windows(columns, doc_of[chunk], start[chunk], windows[chunk]):
                found_rows.append(chunk[r])
                found_columns.append(np.full(len(r), column))
        if found_rows:
            r, column = np.concatenate(found_rows), np.concatenate(found_columns)
            # every occurrence of the segment in its document
            n = first_of[r + 1] - first_of[r]
            occurrence = by_segment[np.repeat(first_of[r], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            place = at[occurrence] + np.repeat(column - start[r], n)
            done = [(int(doc_ids[d]), int(marks[d]), x) for d, x in _intervals(document[occurrence], place, len(doc_ids))]
            yield _mark_rows(done)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of which nothing is removed."""
    for batch in small_batches(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        none = pa.array(np.zeros(len(texts), dtype=np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), none, none, pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "packed", "intervals")]
        for doc_id, packed, intervals in zip(*columns, strict=True):
            text = zstandard.decompress(packed)
            if not intervals:
                out.append((doc_id, len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                continue
            pairs = np.frombuffer(b"".join(intervals), dtype="<u4").reshape(-1, 2).astype(np.int64)
            change = np.zeros(len(text) + 1, dtype=np.int64)
            np.add.at(change, pairs[:, 0], 1)
            np.add.at(change, pairs[:, 1], -1)
            gone = np.cumsum(change)[: len(text)] > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rest = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            out.append((doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=3)
    for batch in small_batches(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array([_mark(t) for t in texts], pa.int64()), pa.array([compressor.compress(t) for t in texts], pa.binary()),
                batch.column("key"),
            ],
            names=["doc_id", "mark", "packed", "key"],
        )


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """What is left of every text without bytes that an earlier document has.

    A byte goes if a string of ``WINDOW`` bytes covers it that also starts in a row with a
    smaller ``doc_id``. One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs), ``kept_sha256``. Null texts count as empty; a null id counts as
    smaller than any other; rows that share an id do not remove from each other. Other
    columns are not looked at. ``hot`` changes how the work is dealt out, not the result.
    """
    texts = id_and_text(docs)
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(MIN_PARTS, -(-total // PART_BYTES))
    dealing = hot_anchors(texts, total, parts, hot)
    sent = texts.mapInArrow(_sender(dealing), SENT).repartition(parts + dealing.more, "part").sortWithinPartitions("part")
    marks = stored(sent.mapInArrow(_marker(parts), MARKS), "marks")
    # rows that the broadcast filter clears keep all they have; only the others are shuffled
    keyed = with_maybe(texts.withColumn("key", F.coalesce("doc_id", F.lit(NO_ID))), F.col("key"), marks.select("doc_id"))
    untouched = keyed.filter("not _maybe").select("doc_id", "text").mapInArrow(_kept, RESULT)
    packed = keyed.filter("_maybe").select("doc_id", "text", "key").mapInArrow(_packed, "doc_id long, mark long, packed binary, key long")
    # per row of documents as many intervals as its own segments give
    marks = marks.groupBy("doc_id", "mark").agg(F.collect_list("intervals").alias("intervals"))
    marks = marks.withColumnsRenamed({"doc_id": "key", "mark": "own"})
    joined = packed.join(marks, (packed["key"] == marks["key"]) & (packed["mark"] == marks["own"]), "left")
    return untouched.unionByName(joined.select("doc_id", "packed", "intervals").mapInArrow(_removed, RESULT))
