"""Operators on texts against brute force, SQL or held-out labels."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, duck
from demur.llm import decontamination, exact_dedup, language_id, near_dedup, personal_data, quality, repeats
from demur.llm.queries import ORACLES, QUERIES
from demur.llm.shingling import counted, shingles
from tests.conftest import SMALL

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_agrees_with_sql(spark, key):
    ok, text = compare(spark, duck(SMALL), key, SMALL, QUERIES, ORACLES)
    assert ok, text


def _plain_removal(rows):
    out = {}
    for doc_id, text in rows:
        own, gone = text.encode(), set()
        earlier = [t.encode() for d, t in rows if d < doc_id]
        for i in range(len(own) - 49):
            if any(own[i: i + 50] in t for t in earlier):
                gone |= set(range(i, i + 50))
        spans = sum(1 for g in gone if g - 1 not in gone)
        kept = bytes(b for i, b in enumerate(own) if i not in gone)
        out[doc_id] = (len(own), len(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats_by_brute_force(spark, seed):
    random.seed(seed)
    letters = ["ab", "abcdefgh ", "é日xy "][seed]
    passages = ["".join(random.choice(letters) for _ in range(random.randint(40, 120))) for _ in range(6)] + ["a" * 130, "ab" * 70]
    rows = []
    for k in range(60):
        parts = [random.choice([*passages, "".join(random.choice("klmnop ") for _ in range(random.randint(0, 80)))]) for _ in range(random.randint(0, 6))]
        rows.append((k * 3, "".join(parts)))
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(spark.createDataFrame(random.sample(rows, len(rows)), DOCS)).collect()}
    assert got == _plain_removal(rows)


def _boilerplate_rows():
    """Documents with one line in common, between words of their own; some share more."""
    random.seed(11)
    line = "All rights reserved by the publishers of this collection of pages. "
    own = ["".join(random.choice("klmnopqrs ") for _ in range(60)) for _ in range(80)]
    rows = [(k, own[k] + line + own[(k + 1) % 80 if k % 3 else (k + 7) % 80]) for k in range(80)]
    return [*rows, (90, "a" * 120), (91, "b" + "a" * 120), (92, line), (None, line + own[5]), (92, line + "!")]


@pytest.mark.parametrize("hot", [0, 20])
def test_repeats_of_hot_anchors_by_brute_force(spark, hot):
    rows = _boilerplate_rows()
    docs = spark.createDataFrame(random.sample(rows, len(rows)), DOCS).repartition(5)
    found = repeats.hot_anchors(docs, sum(len(t) for _, t in rows), 48, hot)
    assert found.hot is not None and found.more > 0
    truth = []
    for doc_id, text in rows:
        earlier = [(-1, t) for d, t in rows if (-1 if d is None else d) < (-1 if doc_id is None else doc_id)]
        truth.append((doc_id, *_plain_removal([*earlier, (0, text)])[0]))
    got = [tuple(r) for r in repeats.remove_repeats(docs, hot=hot).collect()]
    assert sorted(got, key=str) == sorted(truth, key=str)


def test_no_part_gets_all_segments_of_a_hot_anchor(spark):
    random.seed(12)
    line = "All rights reserved by the publishers of this collection of pages. "
    rows = [(k, "".join(random.choice("klmnopqrs ") for _ in range(60)) + line + str(k) * 20) for k in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    found = repeats.hot_anchors(docs, sum(len(t) for _, t in rows), 48, 20)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in rows]), "text": pa.array([t for _, t in rows])})

    def most(dealing):
        counts = Counter()
        for sent in repeats._sent(batch, dealing):
            for part, mark, packed in zip(*[sent.column(c).to_pylist() for c in ("part", "mark", "packed")], strict=True):
                if mark is None and part < dealing.parts:
                    anchors = repeats._Parts(packed).rows()[:, repeats._LEFT: repeats._LEFT + repeats.ANCHOR]
                    counts.update(a.tobytes() for a in anchors)
        return max(counts.values())

    assert most(repeats.Dealing(48)) > 300
    assert most(found) <= 40


def test_common_prefix_with_the_last_suffix():
    """Q is last in order and equal to the others for 26 bytes only."""
    random.seed(4)
    tail = bytes(random.choice(b"bcdefghijk") for _ in range(50))
    p1, p2, q = tail, tail, tail[:26] + b"z" * 24
    rows = np.array([list(left * 33 + s + t) for left, s, t in ((b"l", b"x", p1), (b"m", b"y", p2), (b"n", b"x", q))], dtype=np.uint8)
    docs = np.array([1, 2, 3])
    columns = (rows[:, c] for c in range(repeats.COLUMNS - 1, -1, -1))
    got = {(int(r), c) for found, c in repeats.equal_windows(columns, docs, np.zeros(3, np.int64), np.full(3, 35)) for r in found}
    truth = {(r, c) for r in range(3) for c in range(35) if any((rows[o, c: c + 50] == rows[r, c: c + 50]).all() for o in range(r))}
    assert got == truth == {(1, 34)}


def test_rows_of_one_id_do_not_remove_from_each_other(spark):
    text = "the very same passage of more than fifty bytes, written twice here"
    rows = spark.createDataFrame([(1, text), (1, text), (1, text + "!"), (2, text)], DOCS)
    assert sorted((r["doc_id"], r["n_removed"]) for r in repeats.remove_repeats(rows).collect()) == [(1, 0), (1, 0), (1, 0), (2, len(text))]


def _weighted(text):
    _, hashes, counts = counted(*shingles(pa.array([text])))
    return dict(zip(hashes.tolist(), counts.tolist(), strict=True))


def _classes(rows, threshold=0.8):
    sets = {d: _weighted(t) for d, t in rows}
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(parent), 2):
        x, y = sets[a], sets[b]
        common = sum(min(c, y.get(h, 0)) for h, c in x.items())
        total = sum(x.values()) + sum(y.values()) - common
        if total and common / total >= threshold - 1e-12:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in parent}


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_SHINGLES, 0])
def test_contaminated_rows_that_share_an_id(spark, monkeypatch, limit):
    """Both paths judge each row by itself."""
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", limit)
    item = " ".join(f"item{k}" for k in range(40))
    clean = " ".join(f"clean{k}" for k in range(40))
    rows = [(None, item), (None, clean), (None, None), (5, "before " + item), (5, clean), (5, clean), (6, clean)]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontamination.drop_contaminated(spark.createDataFrame(rows, DOCS), items).collect()
    assert sorted(map(tuple, got), key=str) == sorted((r for r in rows if not r[1] or "item0" not in r[1]), key=str)


def test_near_copies_among_rows_that_share_an_id(spark):
    """The copy goes, not the row that comes last in the order of the texts."""
    text = " ".join(f"word{k}" for k in range(60))
    other = "zebras " + " ".join(f"other{k}" for k in range(40))
    for ident in (None, 7):
        rows = [(ident, text), (ident, text + " end"), (ident, other), (ident, other), (9, "one more text that has nothing in common")]
        got = [r["text"] for r in near_dedup.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()]
        assert len(got) == 3 and other in got and rows[4][1] in got
        assert (text in got) != (text + " end" in got)


def test_near_duplicates_by_brute_force(spark):
    """A large loose group, in which most pairs are close to the threshold on either side."""
    random.seed(9)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [random.choice(vocabulary) for _ in range(220)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(random.randint(0, 9)):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        rows.append((k, " ".join(words)))
    shared = " ".join(random.choice(vocabulary) for _ in range(90))
    rows += [(200 + k, shared + " " + " ".join(random.choice(vocabulary) for _ in range(60))) for k in range(80)]
    rows += [(400 + k, " ".join(random.choice(vocabulary) for _ in range(k))) for k in range(12)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == _classes(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    hashes = np.sort(rng.integers(1, 2**63, 60).astype(np.uint64))
    a, b = rng.uniform(0, 6, 60), rng.uniform(0, 6, 60)
    owner = np.repeat([0, 1], 60)
    sig = near_dedup.dart_signatures(owner, np.concatenate([hashes, hashes]), np.concatenate([a, b]), 2, k=4096)
    assert (sig != 0).all()
    assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_blocks_link_across_components():
    texts = {"a": "one two three four five six seven eight", "b": "one two three four five six seven eight nine", "c": "x y z u v w"}
    import zstandard

    rows = [
        {"node": k.encode(), "label": k.encode(), "block": i % 2, "packed": zstandard.compress(t.encode())}
        for i, (k, t) in enumerate(texts.items())
    ]
    found = near_dedup._block_links(rows, 0, 1, 0.75).to_pylist()
    assert found == [{"a": b"a", "b": b"b"}]


def _contained(docs, items, threshold=0.8):
    out = set()
    for d, text in docs:
        own = set(_weighted(text)) if text else set()
        for i, item in items:
            wanted = set(_weighted(item)) if item else set()
            if wanted and len(wanted & own) >= threshold * len(wanted) - 1e-9:
                out.add((d, i, len(wanted & own), len(wanted)))
    return out


def test_items_found_in_long_documents(spark):
    random.seed(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(random.choice(vocabulary) for _ in range(random.choice([1, 3, 5, 6, 12, 25, 60])))) for k in range(40)]
    items += [(90, None), (91, ""), (92, " ,. "), (None, items[3][1]), items[5], items[5]]
    docs = []
    for k in range(60):
        words = [random.choice(vocabulary) for _ in range(random.choice([10, 300, 9000]))]
        for _ in range(random.randint(0, 3)):
            item = (random.choice(items)[1] or "").split()
            if item and random.random() < 0.5:
                item[random.randrange(len(item))] = "changed"
            at = random.randrange(len(words))
            words[at:at] = item
        docs.append((k, " ".join(words)))
    docs += [(100, None), (101, ""), (102, "..")]
    want = _contained(docs, items)
    assert len(want) > 20
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    for bound in (decontamination.BROADCAST_SHINGLES, 0):  # broadcast, and the join for many items
        found = decontamination.find_items(*frames, broadcast_shingles=bound).collect()
        assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in found} == want
        assert len(found) == len(want)


def test_items_are_found_by_joining_without_tiny_ones(spark):
    """Without items below TINY shingles the second form is not made, and nothing is lost."""
    words = [f"w{i}" for i in range(400)]
    random.seed(11)
    items = [(i, " ".join(random.choices(words, k=random.randint(40, 70)))) for i in range(30)]
    docs = [(k, " ".join(random.choices(words, k=50) + (items[k][1].split() if k < 30 else []) + random.choices(words, k=50 * (k % 5)))) for k in range(60)]
    docs.append((None, docs[3][1]))
    want = _contained(docs, items)
    assert len(want) > 30
    found = decontamination.find_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), broadcast_shingles=0).collect()
    assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in found} == want


def _decided(rows, **options):
    return {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(rows, **options).collect()}


def test_exact_dedup_with_a_full_filter(spark, monkeypatch):
    """When all bits are set every row is shuffled, and nothing else changes."""
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3000).cast("string").alias("text"))
    want = _decided(rows)
    assert sum(k for *_, k in want) == 3000
    monkeypatch.setattr(exact_dedup, "_ranges", lambda rows, max_bits: (64, [(-(1 << 63), (1 << 63) - 1)]))
    assert _decided(rows) == want


def test_exact_dedup_in_ranges_of_the_hash(spark):
    """A bounded filter for each range finds what one large filter finds."""
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3000).cast("string").alias("text"))
    bits, ranges = exact_dedup._ranges(5000, 1 << 14)
    assert bits <= 1 << 14 and len(ranges) == 5
    assert ranges[0][0] == -(1 << 63) and ranges[-1][1] == (1 << 63) - 1
    assert all(hi + 1 == lo for (_, hi), (lo, _) in zip(ranges[:-1], ranges[1:], strict=True))
    assert _decided(rows, max_bits=1 << 14) == _decided(rows)


def test_exact_dedup_shuffles_possibly_repeated_rows_only(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.greatest(F.col("id"), F.lit(100)).cast("string").alias("text"))
    hashed = exact_dedup._digests(rows, "text", "doc_id").withColumn("row", F.monotonically_increasing_id())
    for max_bits in (exact_dedup.MAX_BITS, 1 << 18):  # one range, three ranges
        probed = exact_dedup._probed(hashed, max_bits)
        maybe = {r["doc_id"] for r in probed.filter("maybe").collect()}
        assert set(range(101)) <= maybe and len(maybe) < 0.09 * 40_000
        assert probed.count() == 40_000
    # pass one sends a bit and its count
    plan = exact_dedup.repeated_bits(hashed, 1 << 20)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "sha2" not in plan and "Python" not in plan and "Arrow" not in plan


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    own = [(r["lang"], found[r["doc_id"]]) for r in docs.collect() if found[r["doc_id"]]["held_out"]]
    assert len(own) > 20
    assert np.mean([lang == r["lang_pred"] for lang, r in own]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_no_language_without_letters(spark, odd_docs):
    found = [(r["text"], r["lang_pred"]) for r in odd_docs.join(language_id.identify(odd_docs).select("doc_id", "lang_pred"), "doc_id").collect()]
    assert {p for t, p in found if not t or not re.search(r"[^\W\d_]", t)} == {"und"}
    assert "und" not in {p for t, p in found if t and "word0" in t}


def test_forward_sum_is_over_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "ba", "▁a"]
    probability = np.array([[0.2], [0.1], [0.15], [0.2], [0.05], [0.25], [0.05]])
    unigrams = language_id.Unigrams(language_id.PieceTable(pieces), probability)

    def total(text):
        if not text:
            return 1.0
        p = dict(zip(pieces, probability[:, 0], strict=False))
        out = sum(p[x] * total(text[len(x):]) for x in pieces if text.startswith(x))
        return out + (0.05 * total(text[1:]) if text[0] not in p else 0)

    for word in ("ab", "abba", "bab", "axb", "b" * 30):
        assert np.exp(unigrams.log_probability([word])[0, 0]) == pytest.approx(total("▁" + word))


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(found) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in found]) > 0.93


_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain_spans(text):
    out = {}
    for kind, pattern in _PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
            ok = ok or kind == "card" and 16 <= len(digits) <= 19 and personal_data.luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15
            if ok:
                out[kind].append(m.span())
    return out


def test_base_spans_by_brute_force():
    random.seed(3)
    for _ in range(30_000):
        text = "".join(random.choice("0123456789" * 2 + "..-- ()++@@ab_é") for _ in range(random.randint(0, 40)))
        assert personal_data.base_spans(text) == _plain_spans(text), text
    assert personal_data.base_spans("4111 1111 1111 1111")["card"] == [(0, 19)]
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1" + " " * 300_000):
        personal_data.base_spans(text)  # in linear time


def test_personal_data_rows(spark):
    texts = ["mail joe@mail.example.com or 10.0.0.1", None, "", "no data here", "call +1 (389) 555-5010 or 4111111111111111", "write to ann.b [at] mail [dot] com"]
    rows = personal_data.find_personal_data(spark.createDataFrame(list(enumerate(texts)), DOCS)).orderBy("doc_id").collect()
    assert [(r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in rows] == [(1, 1, 0, 0), (0,) * 4, (0,) * 4, (0,) * 4, (0, 0, 1, 1), (0,) * 4]
    for r, text in zip(rows, texts, strict=True):
        base = [f"{k}:{a}:{b}" for k, spans in _plain_spans(text or "").items() for a, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) or not base


def test_labelers_are_weighed_by_agreement():
    """A labeler that votes at random gets chances near one half; the reliable ones do not."""
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.5
    votes = np.stack([np.where(rng.random(4000) < r, truth, ~truth) + 1 for r in (0.95, 0.9, 0.85, 0.5)], axis=1)
    seen = Counter(map(tuple, votes.tolist()))
    patterns, counts = np.array(list(seen)), np.array(list(seen.values()), dtype=float)
    p, chance = personal_data.reliabilities(patterns, counts)
    right = sum(n for (v, n), q in zip(seen.items(), p, strict=True) if (q > 0.5) == (sum(x == 2 for x in v[:3]) >= 2))
    assert right / 4000 > 0.9
    assert abs(chance[1, 3, 2] / (chance[1, 3, 1] + chance[1, 3, 2]) - 0.5) < 0.1


def test_oracle_queries_run_over_all_documents(spark):
    con = duckdb.connect()
    n = con.sql(f"SELECT count(*) FROM '{SMALL}/documents.parquet'").fetchall()[0][0]
    for key in ("op4_language_id", "op9_quality_classifier", "op10_personal_data", "op6_token_output"):
        assert QUERIES[key](spark, SMALL).count() == n
