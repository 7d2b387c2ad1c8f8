"""Quality scores by nearest-neighbour voting among labelled documents.

A document is a bag of style terms: trigrams of character classes, and how well the text
compresses. Labelled documents give the weights of the terms and, by truncated singular
value decomposition, the latent space. Their vectors in that space are broadcast; every
document is projected into it and compared with all of them, in blocks, by exact cosine.
The nearest ones vote with their label, weighted by a power of the similarity.

``NEIGHBOURS_PER_LABEL`` rows of each label are kept as voters (those whose id has the
smallest hash), so that what is broadcast has a fixed bound: 2 x 1,500 vectors of 48 floats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.llm.common import checksum_part, fitted, id_and_text, small_batches

NEIGHBOURS_PER_LABEL = 1500
DIMENSIONS = 48
VOTERS = 15
POWER = 8
THRESHOLD = 0.7
#: a text of so many bytes says as much as the prior; the fit takes what predicts the voters best from the others
PRIOR_BYTES = (0, 3, 10, 30, 100, 300)
FOLDS, HELD_OUT_FOLD = 4, 2

_CLASSES = 16
_TRIGRAMS = _CLASSES**3
_RATIO_BINS = 24
TERMS = _TRIGRAMS + _RATIO_BINS
#: weight of the compression terms beside a bag of trigrams of length 1
_RATIO_WEIGHT = 0.5
_ROWS = 500


def _classes() -> np.ndarray:
    table = np.full(256, 15, dtype=np.int32)
    groups = (
        (0, b"abcdefghijklmnopqrstuvwxyz"), (1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (3, b" \t"), (4, b"\r\n"), (5, b"."),
        (6, b",;:"), (7, b"!?"), (8, b"|"), (9, b"#$%&*@~^"), (10, b"-_/\\=+<>"), (11, b"\"'()[]{}`"),
        (12, range(0xC0, 0x100)), (13, range(0x80, 0xA0)), (14, range(0xA0, 0xC0)),
    )
    for value, members in groups:
        table[list(members)] = value
    return table


_CLASS_OF = _classes()


def features(texts: pa.Array) -> np.ndarray:
    """Term counts, one row per text; a null text has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]: offsets[-1]]
    at = offsets - offsets[0]
    n = len(texts)
    out = np.zeros((n, TERMS), dtype=np.float32)
    if len(raw) >= 3:
        codes = _CLASS_OF[raw]
        tri = (codes[:-2] * _CLASSES + codes[1:-1]) * _CLASSES + codes[2:]
        doc = np.repeat(np.arange(n), np.diff(at))
        inside = doc[:-2] == doc[2:]
        cell = (doc[:-2] * _TRIGRAMS + tri)[inside]
        out[:, :_TRIGRAMS] = np.bincount(cell, minlength=n * _TRIGRAMS).reshape(n, _TRIGRAMS)
    compressor = zstandard.ZstdCompressor(level=1)
    for i in range(n):
        size = int(at[i + 1] - at[i])
        if size >= 64:
            ratio = len(compressor.compress(raw[at[i]: at[i + 1]].tobytes())) / size
            # long texts compress better; compared on the scale of their length
            place = min(_RATIO_BINS - 1.001, max(0.0, ratio * 1.0 * _RATIO_BINS * 1.2))
            low = int(place)
            out[i, _TRIGRAMS + low] = 1 - (place - low)
            out[i, _TRIGRAMS + low + 1] = place - low
    return out


@dataclass
class Voters:
    """Labelled vectors and the way into their space."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    prior_bytes: float = 0

    def project(self, counts: np.ndarray) -> np.ndarray:
        vectors = _weighted(counts, self.weights) @ self.basis
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of the nearest voters' weight that is for label 1, drawn to the prior for short texts."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        return self.drawn(*self.votes(self.project(counts) @ self.vectors.T), counts[:, :_TRIGRAMS].sum(axis=1))

    def shares(self) -> np.ndarray:
        """How many labelled rows each voter stands for, relative to the others: fewer of the commoner label were chosen."""
        ones = self.labels.mean()
        if not 0 < ones < 1:
            return np.ones(len(self.labels))
        return np.where(self.labels == 1, self.prior / ones, (1 - self.prior) / (1 - ones))

    def votes(self, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of the nearest voters for label 1, and of all of them."""
        k = min(VOTERS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1).astype(np.float64) ** POWER * self.shares()[near]
        return (weight * self.labels[near]).sum(axis=1), weight.sum(axis=1)

    def drawn(self, voted: np.ndarray, total: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Shares for texts with so many trigrams; without terms or neighbours the prior alone."""
        trust = np.where((total > 1e-9) & (size > 0), size / np.maximum(size + self.prior_bytes, 1e-9), 0)
        return np.clip(trust * voted / np.maximum(total, 1e-9) + (1 - trust) * self.prior, 0, 1)

    def fit_prior(self, counts: np.ndarray) -> None:
        """How far short texts are drawn to the prior: fewest wrong predictions of voters judged by
        all others, then least logarithmic loss."""
        if len(self.labels) < 2:
            return
        own = self.shares()
        size = counts[:, :_TRIGRAMS].sum(axis=1)
        voted, total = np.empty(len(counts)), np.empty(len(counts))
        for lo in range(0, len(counts), _ROWS):
            cosine = self.vectors[lo: lo + _ROWS] @ self.vectors.T
            cosine[np.arange(len(cosine)), np.arange(lo, lo + len(cosine))] = -1.0
            voted[lo: lo + _ROWS], total[lo: lo + _ROWS] = self.votes(cosine)
        losses = []
        for self.prior_bytes in PRIOR_BYTES:
            score = self.drawn(voted, total, size)
            wrong = (own * ((score >= THRESHOLD) != (self.labels == 1))).sum()
            score = np.clip(score, 0.01, 0.99)
            losses.append((round(wrong, 6), -(own * np.where(self.labels == 1, np.log(score), np.log(1 - score))).sum()))
        self.prior_bytes = PRIOR_BYTES[losses.index(min(losses))]


def _weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    bag = np.log1p(counts[:, :_TRIGRAMS]) * weights
    bag /= np.maximum(np.linalg.norm(bag, axis=1, keepdims=True), 1e-12)
    return np.hstack([bag, _RATIO_WEIGHT * counts[:, _TRIGRAMS:]]).astype(np.float32)


def fit_space(counts: np.ndarray, labels: np.ndarray, prior: float, dimensions: int = DIMENSIONS) -> Voters:
    """Term weights and latent space of the labelled rows."""
    if not len(labels):
        return Voters(np.ones(_TRIGRAMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, prior)
    having = (counts[:, :_TRIGRAMS] > 0).sum(axis=0)
    weights = np.log((1 + len(labels)) / (1 + having)).astype(np.float32) + 0.3
    rows = _weighted(counts, weights)
    # range of the rows by a few rounds of power iteration from a fixed start
    probe = np.random.default_rng(0).standard_normal((TERMS, dimensions + 8)).astype(np.float32)
    for _ in range(4):
        probe, _ = np.linalg.qr(rows.T @ (rows @ probe))
    _, _, turn = np.linalg.svd(rows @ probe, full_matrices=False)
    basis = (probe @ turn.T)[:, :dimensions].astype(np.float32)
    voters = Voters(weights, basis, np.zeros((0, dimensions), np.float32), labels, prior)
    voters.vectors = voters.project(counts)
    voters.fit_prior(counts)
    return voters


def train(docs: DataFrame, labels: DataFrame, per_label: int = NEIGHBOURS_PER_LABEL) -> Voters:
    """Learn from the labelled rows outside the held-out fold.

    Rows with a null label or id are left out; an id labelled twice counts with its
    smallest label. Without labelled rows every score is 1: nothing speaks against a text.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    marked = marked.filter("doc_id is not null and label in (0, 1)").filter(checksum_part("doc_id", FOLDS) != HELD_OUT_FOLD)
    marked = marked.groupBy("doc_id").agg(F.min("label").alias("label"))
    totals = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return fit_space(np.zeros((0, TERMS), np.float32), np.zeros(0), 1.0)
    chosen = None
    for label in sorted(totals):
        some = marked.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = id_and_text(docs).join(F.broadcast(chosen), "doc_id")  # at most 2 x per_label ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, rows=_ROWS):
            bag = features(batch.column("text")).astype("<f4")
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "bag": [zstandard.compress(b.tobytes()) for b in bag]}
            )

    prior = totals.get(1, 0) / sum(totals.values())

    def fit(rows: list[dict]) -> Voters:
        rows = sorted(rows, key=lambda r: (r["doc_id"], r["bag"]))
        first = {r["doc_id"]: r for r in reversed(rows)}  # repeated ids vote once
        rows = [first[k] for k in sorted(first)]
        counts = np.array([np.frombuffer(zstandard.decompress(r["bag"]), dtype="<f4") for r in rows], dtype=np.float32).reshape(-1, TERMS)
        return fit_space(counts, np.array([r["label"] for r in rows], dtype=np.float64), prior)

    return fitted(texts.mapInArrow(count, "doc_id long, label int, bag binary"), fit)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (score >= 0.7) of every row.

    A text without terms (null, empty, under three bytes) gets the share of label 1 among
    the labelled rows. A null id is never held out. Other columns are not looked at.
    """
    voters = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, rows=_ROWS):
            scores = voters.value.scores(features(batch.column("text")))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64())})

    scored = id_and_text(docs).mapInArrow(score, "doc_id long, score double")
    held_out = F.coalesce(checksum_part("doc_id", FOLDS) == HELD_OUT_FOLD, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose predicted label is 1, columns as they are."""
    voters = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, rows=_ROWS):
            yield batch.filter(pa.array(voters.value.scores(features(batch.column("text"))) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
