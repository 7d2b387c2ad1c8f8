"""Benchmark items inside documents, by size-partitioned MinHash and exact containment.

Containment is the share of an item's different five-word shingles that a document has. An
item is short and a document may be long, so their Jaccard similarity is tiny, and a
signature of fixed length would miss it. Documents are therefore partitioned by size: one
with up to 2^c shingles gets a one-permutation MinHash signature of 2^c bins (the leading
c bits of the hash choose the bin, the smallest hash in it is the value). At a load of one
shingle per bin at most, each shared shingle is the value of its bin with a chance of 0.63
or more, so an item of 16 shingles contained to 0.8 is missed with a chance below 0.000003.
Items of fewer shingles get one bin per shingle, which misses nothing. A pair that shares
one value is verified by counting all shared shingles.

The item signatures are broadcast when they have ``BROADCAST_SHINGLES`` hashes at most (16
MB). Otherwise documents and items meet in a join on (size class, value).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.llm.common import id_and_text, small_batches, stored, with_maybe
from demur.llm.shingling import counted, shingles

THRESHOLD = 0.8
#: items with fewer shingles are looked up by all of them
TINY = 16
MIN_CLASS, MAX_CLASS = 4, 40
BROADCAST_SHINGLES = 2_000_000

PAIRS = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def size_class(n: np.ndarray) -> np.ndarray:
    """Exponent of the number of bins for sets of n shingles."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1))), MIN_CLASS, MAX_CLASS).astype(np.int64)


def bin_minima(owner: np.ndarray, hashes: np.ndarray, exponent: np.ndarray) -> np.ndarray:
    """Which of the sorted (owner, hash) rows are the smallest of their bin."""
    bins = hashes >> (np.uint64(64) - exponent.astype(np.uint64))
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (bins[1:] != bins[:-1])
    return first


class Items:
    """Shingles of the items and their signatures for every size class."""

    def __init__(self, ids: list[int | None], sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        self._by_class: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return self.ids, self.sets

    def __setstate__(self, state):
        self.__init__(*state)

    def signature(self, exponent: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted values and their items; -1 for the values of tiny items."""
        if exponent not in self._by_class:
            values, owners = [], []
            for k, hashes in enumerate(self.sets):
                if not len(hashes) or (len(hashes) < TINY) != (exponent < 0):
                    continue
                if exponent >= 0:
                    hashes = hashes[bin_minima(np.zeros(len(hashes)), hashes, np.full(len(hashes), exponent))]
                values.append(hashes)
                owners.append(np.full(len(hashes), k))
            values = np.concatenate(values) if values else np.zeros(0, dtype=np.uint64)
            owners = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
            order = np.argsort(values, kind="stable")
            self._by_class[exponent] = values[order], owners[order]
        return self._by_class[exponent]

    def candidates(self, owner: np.ndarray, hashes: np.ndarray, exponent: int) -> np.ndarray:
        """Pairs (text, item) that share a value of the signatures."""
        values, owners = self.signature(exponent)
        lo, hi = np.searchsorted(values, hashes, "left"), np.searchsorted(values, hashes, "right")
        n = hi - lo
        text = np.repeat(owner, n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return np.unique(np.stack([text, owners[at]], axis=1), axis=0)


def _matches(items: Items, texts: pa.Array, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(text, item, shared shingles) of all verified pairs of a batch."""
    owner, hashes, _ = counted(*shingles(texts))
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    exponent = size_class(np.diff(starts))[owner] if len(owner) else owner
    found = [items.candidates(owner, hashes, -1)]
    minima = bin_minima(owner, hashes, exponent)
    for e in np.unique(exponent):
        own = minima & (exponent == e)
        found.append(items.candidates(owner[own], hashes[own], int(e)))
    for text, item in np.concatenate(found).tolist():
        own, wanted = hashes[starts[text]: starts[text + 1]], items.sets[item]
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        shared = int((own[at] == wanted).sum())
        if shared >= threshold * len(wanted) - 1e-9:
            yield text, item, shared


def _item_sets(items: DataFrame) -> DataFrame:
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            owner, hashes, _ = counted(*shingles(batch.column("text")))
            starts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_pydict({
                "item_id": batch.column("item_id"),
                "shingles": [hashes[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)],
            })

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    return rows.mapInArrow(collect, "item_id long, shingles binary").filter(F.length("shingles") > 0)


def _searched(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    shared_items = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared_items.value
        for batch in small_batches(batches):
            ids = batch.column("doc_id")
            rows = [
                (ids[t].as_py(), known.ids[i], n, len(known.sets[i]), n / len(known.sets[i]))
                for t, i, n in _matches(known, batch.column("text"), threshold)
            ]
            yield _pairs(rows)

    return id_and_text(docs).mapInArrow(search, PAIRS)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "n_shared", "n_item", "containment"]
    )


def _joined(docs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The same search for any number of items: signatures meet in a join. Adds the text's ``digest``.

    Broadcast filters of the items' values, then of the rows with candidates, spare the
    shuffles most other values and texts; the joins decide.
    """
    texts = stored(id_and_text(docs).withColumn("row", F.monotonically_increasing_id()), "texts")
    sets = stored(sets.withColumn("item", F.monotonically_increasing_id()), "items")
    has_tiny = bool(sets.filter(F.length("shingles") < 8 * TINY).limit(1).count())

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            owner, hashes, _ = counted(*shingles(batch.column("text")))
            if not len(owner):
                continue
            exponent = size_class(np.bincount(owner, minlength=batch.num_rows))[owner]
            minima = bin_minima(owner, hashes, exponent)
            row = batch.column("row").to_numpy()
            forms = [(minima, exponent[minima])]
            if has_tiny:
                forms.append((np.ones(len(owner), bool), np.full(len(owner), -1)))
            for keep, e in forms:
                yield pa.RecordBatch.from_pydict({"class": e.astype(np.int32), "value": hashes[keep].view(np.int64), "row": row[owner[keep]]})

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column("item").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                hashes = np.frombuffer(raw, dtype=np.uint64)
                for e in [-1] if len(hashes) < TINY else range(MIN_CLASS, MAX_CLASS + 1):
                    own = hashes if e < 0 else hashes[bin_minima(np.zeros(len(hashes)), hashes, np.full(len(hashes), e))]
                    yield pa.RecordBatch.from_pydict({
                        "class": np.full(len(own), e, np.int32), "value": own.view(np.int64), "item": np.full(len(own), item)
                    })

    right = stored(sets.mapInArrow(of_items, "class int, value long, item long"), "item-values")
    value = F.xxhash64("class", "value")
    left = with_maybe(texts.mapInArrow(of_docs, "class int, value long, row long"), value, right.select(value)).filter("_maybe")
    pairs = stored(left.join(right, ["class", "value"]).select("row", "item").distinct(), "candidates")
    near = with_maybe(texts, F.col("row"), pairs.select("row")).filter("_maybe")
    both = pairs.join(near.select("row", "doc_id", "text"), "row").join(sets, "item").select(
        "doc_id", "text", "item_id", "shingles", F.sha2("text", 256).alias("digest")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            owner, hashes, _ = counted(*shingles(batch.column("text")))
            starts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            rows, digests = [], []
            ids = zip(batch.column("doc_id").to_pylist(), batch.column("item_id").to_pylist(), batch.column("shingles").to_pylist(), strict=True)
            digest = batch.column("digest").to_pylist()
            for k, (doc_id, item_id, raw) in enumerate(ids):
                wanted = np.frombuffer(raw, dtype=np.uint64)
                n = int(np.isin(wanted, hashes[starts[k]: starts[k + 1]]).sum())
                if n >= threshold * len(wanted) - 1e-9:
                    rows.append((doc_id, item_id, n, len(wanted), n / len(wanted)))
                    digests.append(digest[k])
            yield _pairs(rows).append_column("digest", pa.array(digests, pa.string()))

    return both.mapInArrow(verify, f"{PAIRS}, digest string")


def find_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """Pairs of a document and an item it contains to the threshold at least.

    ``doc_id``, ``item_id``, ``n_shared``, ``n_item`` (different shingles of the item),
    ``containment``. Texts that are null, empty or without words are in no pair. Repeated
    rows of items count once; repeated rows of documents are each reported. Items without
    an id are searched, too. Other columns are not looked at.
    """
    sets = stored(_item_sets(items), "item-sets")
    total = sets.agg(F.coalesce(F.sum(F.length("shingles")), F.lit(0))).first()[0] // 8
    if total > broadcast_shingles:
        return _joined(docs, sets, threshold).drop("digest")
    rows = sorted(((r["item_id"], bytes(r["shingles"])) for r in sets.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return _searched(docs, Items([r[0] for r in rows], [np.frombuffer(r[1], dtype=np.uint64) for r in rows]), threshold)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item, columns as they are."""
    sets = stored(_item_sets(items), "item-sets")
    total = sets.agg(F.coalesce(F.sum(F.length("shingles")), F.lit(0))).first()[0] // 8
    if total > BROADCAST_SHINGLES:
        # rows that agree in id and text contain the same items; those that agree in the id alone may not
        hit = _joined(docs, sets, threshold).select(F.col("doc_id").alias("_hit"), F.col("digest").alias("_digest")).distinct()
        own = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
        return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit["_hit"]) & (own == hit["_digest"]), "left_anti")
    rows = [(r["item_id"], bytes(r["shingles"])) for r in sets.collect()]
    known = docs.sparkSession.sparkContext.broadcast(Items([r[0] for r in rows], [np.frombuffer(r[1], dtype=np.uint64) for r in rows]))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            clean = np.ones(batch.num_rows, dtype=bool)
            clean[[t for t, _, _ in _matches(known.value, batch.column("text"), threshold)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
