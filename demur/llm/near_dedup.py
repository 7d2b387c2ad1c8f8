"""Near-duplicate documents by DartMinHash signatures, banding and exact verification.

A text is a weighted set: its five-word shingles with their counts. Similarity is weighted
Jaccard (sum of minima over sum of maxima of the counts), ``THRESHOLD`` or more.

Signatures. Every shingle owns regions of (weight, rank) space, one per power of two of the
weight. Darts land in them at hashed places: ranks are a hashed Poisson process, and each
dart has a hashed weight and coordinate. A dart counts if its weight is below the shingle's
count. The earliest dart of every coordinate is the signature, so two sets agree in a
coordinate with a chance equal to their weighted Jaccard similarity. Darts are thrown up to
a rank at which about k ln k of them count; sets with an empty coordinate go on to later ranks.

Banding. ``BANDS`` bands of ``ROWS`` coordinates: a pair at the threshold shares a band with a
chance of 0.9999, a pair at 0.3 with one of 0.02.

Links. Texts with the same words are one node. In each bucket every node is compared with
the smallest one, first by signature, then exactly on the texts. The accepted links are
joined to components. Buckets that still hold several components are compared in blocks of
nodes, exactly and within the task, which returns no more links than join the components. So
no link between components is lost, and pairs of a group are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demur.llm.common import attached, components, forget, id_and_text, release_memory, small_batches, stored, with_maybe
from demur.llm.shingling import counted, mixed, shingle_hashes, word_hashes

THRESHOLD = 0.8
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
#: agreeing coordinates below which a pair is not at the threshold (six standard deviations)
AGREEING = int(THRESHOLD * COORDINATES - 6 * (COORDINATES * THRESHOLD * (1 - THRESHOLD)) ** 0.5)
#: nodes and shingles of a block of a bucket, on average
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 500_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(0xD1B54A32D192ED03)


def _uniform(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers above 0 and up to 1."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def _regions(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray):
    """Rows (owner, key, low weight, width, set's weight) for each power of two below the weight."""
    parts = []
    level, low, width = 0, 0.0, 1.0
    while len(owner):
        with np.errstate(over="ignore"):
            key = mixed(hashes + _LEVEL * np.uint64(level + 1))
        parts.append((owner, key, np.full(len(owner), low), np.full(len(owner), width), weights))
        low, width, level = low + width, (width if level == 0 else 2 * width), level + 1
        more = weights > low
        owner, hashes, weights = owner[more], hashes[more], weights[more]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 5


def dart_signatures(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """Earliest dart of every coordinate (columns) for n weighted sets; 0 for an empty set."""
    out = np.zeros((n, k), dtype=np.uint64)
    total = np.bincount(owner, weights=weights, minlength=n)
    bound = k * (np.log(k) + 3) / np.maximum(total, 1e-12)
    waiting = total > 0
    while waiting.any():
        use = waiting[owner]
        sig = _thrown(owner[use], hashes[use], weights[use].astype(np.float64), bound, n, k)
        out[waiting] = sig[waiting]
        waiting = waiting & (sig == 0).any(axis=1)
        bound = bound * 2
    return out


def _thrown(owner, hashes, weights, bound, n, k) -> np.ndarray:
    owner, key, low, width, weight = _regions(owner, hashes, weights)
    owner = owner.astype(np.int64)
    rank = np.zeros(len(owner))
    cells, ranks, darts = [], [], []
    step = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(owner):
            step = step + np.uint64(1)
            h = mixed(key + _STEP * step)
            rank = rank - np.log(_uniform(h)) / width
            alive = rank <= bound[owner]
            owner, key, low, width, weight, rank, h = (x[alive] for x in (owner, key, low, width, weight, rank, h))
            place = mixed(h ^ _LEVEL)
            counts = low + _uniform(place) * width <= weight
            dart = mixed(place + _STEP)
            cells.append((owner * k + (dart % np.uint64(k)).astype(np.int64))[counts])
            ranks.append(rank[counts])
            darts.append((dart | np.uint64(1))[counts])
    out = np.zeros(n * k, dtype=np.uint64)
    if cells:
        cell, dart = np.concatenate(cells), np.concatenate(darts)
        late_first = np.argsort(-np.concatenate(ranks), kind="stable")
        out[cell[late_first]] = dart[late_first]  # the earliest is written last
    return out.reshape(n, k)


def _fingerprints(words: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """Hash of each text's words in order, None without words."""
    raw = words.astype("<u8").tobytes()
    return [xxhash.xxh3_128_digest(raw[8 * a: 8 * b]) if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, rows=800):
        words, offsets = word_hashes(batch.column("text"))
        sig = dart_signatures(*counted(*shingle_hashes(words, offsets)), batch.num_rows)
        folded = np.zeros((batch.num_rows, BANDS), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for r in range(ROWS):
                folded = mixed(folded * _STEP + sig[:, r::ROWS])
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "row": batch.column("row"), "digest": batch.column("digest"), "node": pa.array(_fingerprints(words, offsets), pa.binary()),
            "size": pa.array(np.diff(offsets), pa.int64()),
            "bands": pa.array([x.tobytes() for x in folded], pa.binary()),
            "sketch": pa.array([x.tobytes() for x in (sig >> np.uint64(8)).astype(np.uint8)], pa.binary()),
        })


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), dtype=np.int64)
        nodes = batch.column("node").take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
        band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(keys), nodes], names=["band", "key", "node"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES) for c in ("sketch_a", "sketch_b"))
        yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= AGREEING))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two counted sets of shingles (sorted hashes, counts)."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    shared = b[0][at] == a[0]
    common = int(np.minimum(a[1][shared], b[1][at[shared]]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        nodes = _fingerprints(*word_hashes(batch.column("text")))
        texts = [zstandard.compress(t.encode("utf-8", "surrogatepass"), 1) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.binary()), "packed": pa.array(texts, pa.binary())})


def _verified(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                texts = dict(zip(a, part.column("packed_a").to_pylist(), strict=True)) | dict(zip(b, part.column("packed_b").to_pylist(), strict=True))
                held = {k: v for k, v in held.items() if k in texts}
                new = [k for k in texts if k not in held]
                plain = pa.array([zstandard.decompress(texts[k]).decode("utf-8", "surrogatepass") for k in new], pa.string())
                owner, hashes, counts = counted(*shingle_hashes(*word_hashes(plain)))
                starts = np.searchsorted(owner, np.arange(len(new) + 1))
                held |= {k: (hashes[x:y], counts[x:y]) for k, x, y in zip(new, starts[:-1], starts[1:], strict=True)}
                keep = [similarity(held[x], held[y]) >= threshold - 1e-12 for x, y in zip(a, b, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        del held
        release_memory()

    return verify


class _Linker:
    """Accepts candidate pairs: by signature, then on the texts."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, threshold: float):
        self.docs, self.nodes, self.threshold = docs, nodes, threshold

    def packed(self, members: DataFrame) -> DataFrame:
        """The compressed texts of the nodes (and of a few others)."""
        ends = members.select("node").distinct().join(self.nodes, "node").select("doc_id")
        # spares the shuffle most of the other texts; joins on the node decide
        near = with_maybe(self.docs, F.col("doc_id"), ends).filter("_maybe").select("doc_id", "text")
        return stored(near.mapInArrow(_packed, "node binary, packed binary").dropDuplicates(["node"]), "packed")

    def links(self, pairs: DataFrame) -> DataFrame:
        a, b = (self.nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
        likely = stored(pairs.join(a, "a").join(b, "b").mapInArrow(_alike, "a binary, b binary"), "likely")
        packed = self.packed(likely.select(F.col("a").alias("node")).union(likely.select("b")))
        pa_, pb = (packed.select(F.col("node").alias(x), F.col("packed").alias(f"packed_{x}")) for x in "ab")
        both = likely.join(pa_, "a").join(pb, "b")
        found = stored(both.mapInArrow(_verified(self.threshold), "a binary, b binary"), "links")
        forget(packed, likely)
        return found

    def links_across(self, buckets: DataFrame, labels: DataFrame) -> DataFrame:
        """Links between components within buckets that hold several of them."""
        rows = buckets.join(labels, "node", "left").join(self.nodes.select("node", "size"), "node")
        rows = rows.select("band", "key", "node", "size", F.coalesce("label", "node").alias("label"))
        rows = attached(
            rows, ["band", "key"], "node",
            {"n": F.count("*"), "total": F.sum("size"), "lo": F.min("label"), "hi": F.max("label")},
            {"n": F.sum("n"), "total": F.sum("total"), "lo": F.min("lo"), "hi": F.max("hi")},
        ).filter("lo != hi and n > 2")
        blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("total") / BLOCK_SHINGLES)).cast("int")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        rows = stored(rows.select("band", "key", "node", "label", "block", blocks.alias("blocks")), "residual")
        packed = self.packed(rows)
        paired = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        group = ["band", "key", "low", "high"]
        paired = paired.select(
            "band", "key", "node", "label", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
        ).join(packed, "node").repartition(*group).sortWithinPartitions(*group)
        found = stored(paired.mapInArrow(_across(self.threshold), "a binary, b binary"), "links")
        forget(packed, rows)
        return found


def _shared_matrix(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sums of minima of the counts for every two counted sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [int(c.sum()) for _, c in sets])
    parts = []
    with np.errstate(over="ignore"):
        for hashes, counts in sets:  # the k-th time a shingle occurs is an element of its own
            again = np.repeat(hashes, counts)
            nth = np.arange(len(again)) - np.repeat(np.cumsum(counts) - counts, counts)
            parts.append(mixed(again + _STEP * nth.astype(np.uint64)))
    _, element, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    several = times[element] > 1
    owner, element = owner[several], np.unique(element[several], return_inverse=True)[1]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    out = np.zeros((n, n), dtype=np.float32)
    for lo in range(0, int(element[-1]) + 1 if len(element) else 0, 2048):
        x, y = np.searchsorted(element, (lo, lo + 2048))
        block = np.zeros((n, 2048), dtype=np.float32)
        block[owner[x:y], element[x:y] - lo] = 1
        out += block @ block.T
    return out


def _block_links(rows: list[dict], low: int, high: int, threshold: float) -> pa.RecordBatch:
    """Links between the two blocks' components; no more than join them."""
    texts = pa.array([zstandard.decompress(r["packed"]).decode("utf-8", "surrogatepass") for r in rows], pa.string())
    owner, hashes, counts = counted(*shingle_hashes(*word_hashes(texts)))
    starts = np.searchsorted(owner, np.arange(len(rows) + 1))
    sets = [(hashes[x:y], counts[x:y]) for x, y in zip(starts[:-1], starts[1:], strict=True)]
    size = np.array([float(c.sum()) for _, c in sets])
    common = _shared_matrix(sets)
    alike = common >= (threshold - 1e-9) * (size[:, None] + size[None, :] - common)
    block = np.array([r["block"] for r in rows])
    alike &= (block[:, None] == low) & (block[None, :] == high)
    parent = {r["label"]: r["label"] for r in rows}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i, j in np.argwhere(alike).tolist():
        a, b = root(rows[i]["label"]), root(rows[j]["label"])
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append((rows[i]["node"], rows[j]["node"]))
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _across(threshold: float):
    """Rows come sorted by bucket and pair of blocks; one pair is held at a time."""
    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["band"], r["key"], r["low"], r["high"])
                if key != group:
                    if rows:
                        yield _block_links(rows, group[2], group[3], threshold)
                    group, rows = key, []
                rows.append(r)
        if rows:
            yield _block_links(rows, group[2], group[3], threshold)
        del rows
        release_memory()

    return across


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The class of near-duplicates that each row belongs to.

    ``doc_id``, ``class_id`` (smallest id in the class), ``kept`` (one row of each class).
    Classes are connected by links of ``threshold`` or more. Texts with the same words in the
    same order are always in one class. A text without words is a class by itself. A null
    id comes before all others. Other columns are not looked at.
    """
    return _classed(docs, F.lit(None).cast("binary"), threshold).drop("digest")


def _classed(docs: DataFrame, digest: Column, threshold: float = THRESHOLD) -> DataFrame:
    """The same with a value of each text."""
    texts = id_and_text(docs)
    signed = stored(texts.withColumns({"row": F.monotonically_increasing_id(), "digest": digest}).mapInArrow(
        _signed, "doc_id long, row long, digest binary, node binary, size long, bands binary, sketch binary"
    ), "signed")
    nodes = signed.filter("node is not null").groupBy("node")
    nodes = stored(nodes.agg(F.max("bands").alias("bands"), F.max("sketch").alias("sketch"), F.max("size").alias("size"), F.min("doc_id").alias("doc_id")), "nodes")
    rows = nodes.select("node", "bands").mapInArrow(_banded, "band int, key long, node binary")
    buckets = stored(attached(
        rows, ["band", "key"], "node", {"n": F.count("*"), "head": F.min("node")}, {"n": F.sum("n"), "head": F.min("head")}
    ).filter("n > 1"), "buckets")
    linker = _Linker(texts, nodes, threshold)
    first = linker.links(buckets.filter("node != head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())
    labels = components(first)
    more = linker.links_across(buckets.select("band", "key", "node"), labels)
    if more.limit(1).count():
        labels = components(first.unionByName(more))
    labelled = signed.select("doc_id", "row", "digest", "node").join(labels, "node", "left")
    alone = F.concat(F.lit("row:"), F.col("row").cast("string")).cast("binary")
    labelled = labelled.select("doc_id", "row", "digest", F.coalesce("label", "node", alone).alias("class"))
    head = F.struct("doc_id", "row")
    out = attached(labelled, ["class"], "row", {"head": F.min(head)}, {"head": F.min("head")})
    return out.select("doc_id", F.col("head.doc_id").alias("class_id"), (F.col("head.row") == F.col("row")).alias("kept"), "digest")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class, columns as they are.

    Rows are told apart by id and text. Those that the broadcast filter clears pass straight
    through.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    decided = _classed(docs, _digest()).groupBy("doc_id", "digest").agg(F.count_if("kept").alias("n_kept"), F.count("*").alias("n"))
    plan = stored(decided.filter("n_kept < n").select(key.alias("_key"), F.col("digest").alias("_digest"), "n_kept"), "near-copies")
    # the row as a whole, so that no column of its can clash with ours
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), key.alias("_key"), _digest().alias("_digest"))
    both = F.xxhash64("_key", "_digest")
    keyed = with_maybe(keyed, both, plan.select(both))
    looked_up = keyed.filter("_maybe").join(plan, ["_key", "_digest"], "left")
    out = keyed.filter("not _maybe").select("_doc.*")
    out = out.unionByName(looked_up.filter("n_kept is null").select("_doc.*"))
    # rows that agree in id and text: one stays
    return out.unionByName(looked_up.filter("n_kept > 0").dropDuplicates(["_key", "_digest"]).select("_doc.*"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
