"""Best-fit packing of documents into sequences by linear grouping.

The plan is made on the histogram of piece lengths, which has ``capacity`` entries at most
however many documents there are. Large lengths are sorted and cut into groups of equally
many pieces; every length is rounded up to the largest of its group; the few sizes left are
packed by the configuration linear program (columns priced by a knapsack), of which whole
multiples are used. Actual lengths then take the places of rounded ones, and everything that
is left, small lengths above all, is filled into the tightest space that holds it.

A plan is a list of classes: a content (lengths in a row) and how many sequences have it.
Sequences of a class are numbered in a row, so the place of the r-th piece of a length
follows from r by arithmetic. Spark ranks the pieces of a length in salted windows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demur.llm import words
from demur.llm.common import fitted, id_and_text, salt, small_batches, stored

CAPACITY = 4096
END_ID = 1
#: (share of a sequence above which a length is large, number of groups); the plan that
#: needs the fewest sequences is taken
SETTINGS = ((1 / 2, 128), (1 / 3, 300), (1 / 4, 150))
#: rows of one ranking window, on average over the salts of the commonest length
WINDOW_ROWS = 200_000
#: places are broadcast up to this many rows (about 60 bytes each), else joined by shuffle
BROADCAST_PLACES = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Encoded documents, those longer than a sequence cut into pieces."""
    vocabulary = vocabulary or words.vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = words.encoder(vocabulary)
        end = np.array([end_id], dtype="<u4")
        for batch in small_batches(batches, chars=4_000_000):
            ids, lengths = encoder.encode_many(batch.column("text"))
            at, rows = 0, []
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), lengths.tolist(), strict=True):
                own = np.concatenate([ids[at: at + n], end])
                at += n
                for k, lo in enumerate(range(0, len(own), capacity)):
                    part = own[lo: lo + capacity]
                    rows.append((doc_id, k, lo, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return id_and_text(docs).mapInArrow(cut, PIECES)


def _knapsack(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable content of a sequence, at most ``most`` of each size."""
    best = np.zeros(capacity + 1)
    chosen = []
    for s, v, m in zip(sizes.tolist(), values.tolist(), most.tolist(), strict=True):
        counts = np.zeros(capacity + 1, dtype=np.int16)
        if v > 1e-12:
            base = best.copy()
            for k in range(1, min(m, capacity // s) + 1):
                other = base[: capacity + 1 - k * s] + k * v
                better = other > best[k * s:] + 1e-12
                best[k * s:][better] = other[better]
                counts[k * s:][better] = k
        chosen.append(counts)
    room, content = capacity, np.zeros(len(sizes), dtype=np.int64)
    for i in range(len(sizes) - 1, -1, -1):
        content[i] = chosen[i][room]
        room -= int(content[i]) * int(sizes[i])
    return float(best[capacity]), content


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 200) -> list[tuple[np.ndarray, int]]:
    """Contents and whole multiples of the configuration program's solution, rounded down."""
    k = len(sizes)
    if not k:
        return []
    most = np.minimum(demand, capacity // sizes)
    each = np.maximum(most, 1).astype(float)  # to begin with, every content is of one size
    basis, inverse = np.diag(each), np.diag(1 / each)
    amount = inverse @ demand.astype(float)
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        value, content = _knapsack(sizes, prices, most, capacity)
        if value <= 1 + 1e-4:
            break
        direction = inverse @ content
        ratio = np.full(k, np.inf)
        up = direction > 1e-9
        ratio[up] = np.maximum(amount[up], 0) / direction[up]
        leave = int(np.argmin(ratio))
        step = ratio[leave]
        amount = np.maximum(amount - step * direction, 0)
        amount[leave] = step
        basis[:, leave] = content
        pivot = inverse[leave] / direction[leave]
        inverse = inverse - np.outer(direction, pivot)
        inverse[leave] = pivot
    return [(basis[:, j].astype(np.int64), int(amount[j] + 1e-9)) for j in range(k) if amount[j] >= 1 - 1e-9]


def _groups(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[list[tuple[int, int]]]:
    """Descending lengths cut into groups of equally many pieces: runs (length, count)."""
    total = int(counts.sum())
    size = -(-total // max(1, groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length, n in zip(lengths.tolist(), counts.tolist(), strict=True):
        while n:
            if not room:
                out.append([])
                room = size
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


class Classes:
    """Contents with how many sequences have them, found by the space they leave."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
        self.rooms: list[int] = []
        self.full: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def add(self, content: tuple[tuple[int, int], ...], n: int) -> None:
        room = self.capacity - sum(length * m for length, m in content)
        if room == 0:
            self.full.append((content, n))
            return
        if room not in self.by_room:
            self.by_room[room] = []
            insort(self.rooms, room)
        self.by_room[room].append((content, n))

    def fill(self, length: int, n: int) -> None:
        """Put n pieces of a length where they fit most tightly, into new sequences otherwise."""
        while n:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = min(n, self.capacity // length)
                sequences = n // each
                self.add(((length, each),), sequences)
                n -= each * sequences
                continue
            room = self.rooms[at]
            held = self.by_room[room]
            content, have = held.pop()
            if not held:
                del self.by_room[room]
                del self.rooms[at]
            each = room // length  # the tightest space stays the tightest until it is used up
            if have * each <= n:
                used = have
            elif n >= each:
                used = n // each
            else:
                used, each = 1, n
            self.add((*content, (length, each)), used)
            if have > used:
                self.add(content, have - used)
            n -= used * each

    def all(self) -> list[tuple[tuple[tuple[int, int], ...], int]]:
        return self.full + [c for held in self.by_room.values() for c in held]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, settings=SETTINGS):
    """Classes (content, number of sequences) for a histogram of lengths."""
    plans = [_plan(histogram, capacity, large, groups) for large, groups in settings]
    return min(plans, key=lambda classes: sum(n for _, n in classes))


def _plan(histogram: dict[int, int], capacity: int, large: float, groups: int):
    classes = Classes(capacity)
    left = {length: n for length, n in histogram.items() if n and length < capacity}
    if histogram.get(capacity):
        classes.add(((capacity, 1),), histogram[capacity])
    big = sorted((x for x in left if x > large * capacity), reverse=True)
    grouped = _groups(np.array(big), np.array([left[x] for x in big]), groups) if big else []
    # groups may share their largest length; the sizes of the program differ
    sizes = sorted({g[0][0] for g in grouped}, reverse=True)
    runs: dict[int, list[list[int]]] = {s: [] for s in sizes}
    for g in grouped:
        runs[g[0][0]] += [[length, n] for length, n in g]
    demand = np.array([sum(n for _, n in runs[s]) for s in sizes], dtype=np.int64)
    for content, sequences in configurations(np.array(sizes, dtype=np.int64), demand, capacity):
        places = [s for s, m in zip(sizes, content.tolist(), strict=True) for _ in range(m)]
        while sequences:
            # actual lengths: the next run of each size, as long as all runs last
            need: dict[int, int] = {}
            for s in places:
                need[s] = need.get(s, 0) + 1
            if any(not runs[s] for s in need):
                break
            fits, lengths = sequences, []
            for s, m in need.items():
                length, n = runs[s][0]
                if n >= m:
                    fits = min(fits, n // m)
                    lengths.append((s, [(length, m)]))
                else:  # the run ends inside one sequence
                    taken, parts = 0, []
                    for run in runs[s]:
                        part = min(run[1], m - taken)
                        parts.append((run[0], part))
                        taken += part
                        if taken == m:
                            break
                    if taken < m:
                        fits = 0
                        break
                    fits = 1
                    lengths.append((s, parts))
            if not fits:
                break
            merged: list[tuple[int, int]] = []
            for s, parts in lengths:
                for length, m in parts:
                    merged.append((length, m))
                    left[length] -= m * fits
                    want = m * fits
                    while want:
                        run = next(r for r in runs[s] if r[0] == length)
                        part = min(run[1], want)
                        run[1] -= part
                        want -= part
                        if not run[1]:
                            runs[s].remove(run)
            classes.add(tuple(merged), fits)
            sequences -= fits
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        classes.fill(length, left[length])
    return classes.all()


def places(classes) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces per sequence, first offset)."""
    out, taken, sequence = [], {}, 0
    for content, n in classes:
        offset = 0
        for length, m in content:
            lo = taken.get(length, 0)
            out.append((length, lo, lo + n * m, sequence, m, offset))
            taken[length] = lo + n * m
            offset += length * m
        sequence += n
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Where every piece of every document goes.

    One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``. A null or empty text is a document of the end id alone; rows that share an id are
    packed one by one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocabulary, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = cut.groupBy("length").agg(F.count("*").alias("n"))  # at most ``capacity`` rows
    salts = max(64, (histogram.agg(F.max("n")).first()[0] or 0) // WINDOW_ROWS)
    salted = cut.withColumn("salt", salt("row", salts))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = salted.withColumn("within", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1)
    ranked = ranked.join(first, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    found = fitted(histogram, lambda rows: places(plan({r["length"]: r["n"] for r in rows}, capacity)))
    schema = "length long, lo long, hi long, first_sequence long, per_sequence long, first_offset long"
    table = spark.createDataFrame(found, schema)
    table = F.broadcast(table) if len(found) <= BROADCAST_PLACES else table
    at = F.col("rank") - F.col("lo")
    joined = ranked.join(table, "length").filter("rank >= lo and rank < hi")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + at % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
    )
