import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from demur.llm import packing, token_counts, token_output, words
from demur.llm.common import shared_folder
from tests.conftest import SMALL


def docs_of(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_word_cache_agrees_with_the_library():
    encoder = words.encoder(words.vocabulary_path())
    texts = [
        "it's we'll DON'T. a.'s", "<|endoftext|> x<|startoftext|>y", "İstanbul ΣΑΣ ΟΔΟΣ. é é　x", "áb .́c", "x.'s", "", None, "Straße.ßÀÉ! ÿ",
        "ab1c2 3.4 5", "日本語 テスト。", "ﬁne ½ Ⅻ", " ́a", "a\x0bb", "x" * 5000, "a.b,c", "µ ª º", "Å Å", "'s 're",
    ]
    random.seed(5)
    texts += ["".join(random.choice("abÉß.,'! \n1-") for _ in range(random.randint(0, 60))) for _ in range(500)]
    ids, lengths = encoder.encode_many(pa.array(texts))
    ends = np.cumsum(lengths)
    for text, end, n in zip(texts, ends, lengths, strict=True):
        assert ids[end - n: end].tobytes() == encoder.library(text or ""), text


def test_written_tokens_match_plain_encoding(spark):
    docs = docs_of(spark)
    out = token_output.tokens_in_shared_folder(spark, docs).orderBy("doc_id").collect()
    encoder, start = words.encoder(words.vocabulary_path()), 0
    for row, doc in zip(out, docs.orderBy("doc_id").collect(), strict=True):
        raw = encoder.library(doc["text"]) + np.array([2], dtype="<u4").tobytes()
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc["doc_id"], start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4


def test_reader_decompresses_only_requested_documents(spark):
    docs = docs_of(spark).coalesce(1)
    manifest = token_output.write_tokens(docs, shared_folder(spark, "few"), frame_bytes=4096).orderBy("shard").collect()
    shard = token_output.open_shard(manifest[0]["path"])
    assert len(shard.seek) > 20
    wanted = int(shard.index["doc_id"][len(shard.index) // 2])
    text = docs.filter(F.col("doc_id") == wanted).first()["text"]
    assert shard.documents([wanted])[wanted].tolist() == words.encoder(words.vocabulary_path()).tokenizer.encode(text, add_special_tokens=False).ids + [2]
    assert shard.frames_read <= 2 + 4 * len(text) // 4096


def test_shards_are_plain_zstandard_with_checksums():
    out = io.BytesIO()
    writer = token_output.ShardWriter(out, frame_bytes=64)
    values = [np.arange(n, dtype="<u4") for n in (0, 1, 40, 3)]
    for k, ids in enumerate(values):
        writer.add(k, ids)
    assert writer.finish() == (4, 44)
    raw = out.getvalue()
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True)
    assert stream.read() == b"".join(v.tobytes() for v in values)
    reader = token_output.ShardReader(pa.PythonFile(io.BytesIO(raw), mode="r"))
    assert [reader.ids(k).tolist() for k in range(4)] == [v.tolist() for v in values]
    damaged = bytearray(raw)
    damaged[12] ^= 1
    broken = token_output.ShardReader(pa.PythonFile(io.BytesIO(bytes(damaged)), mode="r"))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        [broken.ids(k) for k in range(4)]


def test_packing_places_every_token_once(spark):
    docs = docs_of(spark)
    rows = packing.pack(docs, capacity=512).collect()
    encoder, pieces = words.encoder(words.vocabulary_path()), {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc in docs.collect():
        own = np.frombuffer(encoder.library(doc["text"]), dtype="<u4").tolist() + [1]
        found = sorted(pieces.pop(doc["doc_id"]), key=lambda r: r["piece"])
        assert [r["start"] for r in found] == list(range(0, len(own), 512))
        for r in found:
            part = np.array(own[r["start"]: r["start"] + 512], dtype="<u4")
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    assert not pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 512) * 1.02 + 1


@pytest.mark.parametrize("seed", range(12))
def test_plans_use_every_piece_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(4, 200))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 400)))
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    classes = packing.plan(histogram, capacity)
    used: dict[int, int] = {}
    for content, n in classes:
        assert sum(length * m for length, m in content) <= capacity
        for length, m in content:
            used[length] = used.get(length, 0) + n * m
    assert used == histogram
    # never worse than first-fit decreasing by more than a few sequences
    bins: list[int] = []
    for length in sorted(lengths.tolist(), reverse=True):
        for k, room in enumerate(bins):
            if room >= length:
                bins[k] -= length
                break
        else:
            bins.append(capacity - length)
    assert sum(n for _, n in classes) <= len(bins) * 1.03 + 2


def test_length_histogram_by_brute_force(spark, odd_docs):
    for docs in (docs_of(spark), odd_docs):
        encoding = token_counts._encoding(token_counts.vocabulary_path())
        lengths = np.array([len(encoding.encode_ordinary(r["text"] or "")) for r in docs.select("text").collect()])
        histogram = token_counts.length_histogram(docs)
        rows = {r["length"]: r for r in histogram.collect()}
        assert sorted(rows) == sorted(set(lengths.tolist()))
        for length, r in rows.items():
            at_least = lengths[lengths >= length]
            assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == ((lengths == length).sum(), len(at_least), at_least.sum())
            assert r["truncated_tokens"] == np.minimum(lengths, length).sum()
            assert r["quantile"] == pytest.approx((lengths <= length).mean())
        limits = [0, 1, 100, 2048, 10**7]
        answers = {r["context"]: (r["n_docs_over"], r["n_tokens"]) for r in token_counts.totals_at(histogram, limits).collect()}
        assert answers == {x: ((lengths > x).sum(), np.minimum(lengths, x).sum()) for x in limits}
        found = {r["share"]: r["length"] for r in token_counts.quantiles(histogram, [0.5, 0.9, 1.0]).collect()}
        assert found == {s: np.sort(lengths)[int(np.ceil(s * len(lengths))) - 1] for s in (0.5, 0.9, 1.0)}
