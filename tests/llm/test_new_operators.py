"""Token alignment, conversation repair and byte-level BPE against plain versions of themselves."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from demur.llm import alignment, byte_bpe, conversations
from tests.conftest import SMALL

TEXTS = [
    "", " ", "   ", "a", " a", "a ", "  a  b   c ", "la.\nLa  \n\n x\t y", "don't we'll 'S", "ab ①▁z", "▁", "<s> </s> <unk> <|endoftext|>", "\x00\x01 b",
    "日本語 テスト。 ｱ", "é ñ 🎉🎉 ﬁ", "x" * 3000, " " * 50, "\n\n\nq", "a  b   c\x85 d\x1c e", "0x41 <0x41> 12345 6.7", "﻿bom", "ing ing ing",
]


def random_texts(n, alphabet="ab Éß.,'! \n1-日▁ ", seed=5, most=80):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


# alignment

def plain_alignment(texts):
    """By definition, with sets of byte places: per text the groups and links, or None."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    symbols, vocabulary = alignment.byte_of_symbol(), {v: k for k, v in a.get_vocab().items()}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(symbols[s] for s in vocabulary[k]) for k in ids_a]
        raw_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        whole = (" " + text).encode()
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            out.append(None)
            continue
        spans = []
        for ids, raw in ((ids_a, raw_a), (ids_b, raw_b)):
            ends = list(itertools.accumulate(map(len, raw)))
            spans.append(list(zip([0, *ends], ends, ids, strict=False)))
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, since = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(k) for lo, hi, k in side if since <= lo and hi <= cut) for side in spans))
            since = cut
        links = [(x, y) for lo, hi, x in spans[0] for lo2, hi2, y in spans[1] if lo < hi2 and lo2 < hi]
        out.append((len(ids_a), len(ids_b), groups, links))
    return out


def expected_alignment(texts):
    found = plain_alignment(texts)
    counts = Counter(link for f in found if f for link in f[3])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        rows.append((
            n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest(),
        ))
    return rows


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 0])
def test_alignment_by_definition(spark, frequent):
    texts = TEXTS + random_texts(300) + [t * 3 for t in TEXTS[:12]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = alignment.align_tokens(docs, frequent=frequent).orderBy("doc_id").collect()
    for text, row, want in zip(texts, rows, expected_alignment(texts), strict=True):
        assert tuple(row[c] for c in ALIGNED) == want, text


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in alignment.align_tokens(docs).collect()}
    some = docs.orderBy("doc_id").collect()
    found = plain_alignment([r["text"] for r in some[:60]])
    for doc, f in zip(some[:60], found, strict=True):
        want = (len(f[2]), len(f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()) if f else (0, 0, "")
        assert rows[doc["doc_id"]][2:4] + rows[doc["doc_id"]][6:] == want
    assert len(rows) == len(some)


def test_slices_change_nothing(monkeypatch):
    coder = alignment.encoders(*(alignment.vocabulary_path(v) for v in (alignment.VOCABULARY_A, alignment.VOCABULARY_B)))
    texts = [" ".join(random_texts(60, seed=k)) for k in range(5)] + TEXTS
    whole = [(d.whole, d.n_a, d.n_b, d.n_links, d.digest.hexdigest(), d.links()[1].sum()) for d in alignment.align_texts(coder, texts)]
    monkeypatch.setattr(alignment, "slices", lambda text: _slices(text, 70))
    cut = [(d.whole, d.n_a, d.n_b, d.n_links, d.digest.hexdigest(), d.links()[1].sum()) for d in alignment.align_texts(coder, texts)]
    assert [c for c in cut if c[0]] == [w for w in whole if w[0]] and [c[0] for c in cut] == [w[0] for w in whole]


_slices = alignment.slices


def test_runs_are_probed_exponentially():
    class Counted(list):
        looks = 0

        def __getitem__(self, k):
            Counted.looks += 1
            return super().__getitem__(k)

    ends = list(range(1, 100_001))
    a, b = Counted(ends), Counted(ends[:50_000] + ends[50_001:])
    stretches, of_a, of_b = alignment.align(a, b)
    assert Counted.looks < 400
    assert stretches == [(0, 50_000, 0, 50_000, True), (50_000, 50_002, 50_000, 50_001, False), (50_002, 100_000, 50_001, 99_999, True)]
    assert len(of_a) == len(of_b) == 100_000


# conversations

def best_repairs(rows):
    """Least cost, its least audit and the repaired text by plain dynamic programming over whole strings."""
    def insert(states):
        for _ in range(2):
            for s, (c, audit, text) in list(states.items()):
                to, role = (2, "user") if s in (0, 1, 3) else (3, "assistant")
                new = (c + 2, audit + "I", text + "\n" * (s > 0) + role + ":")
                if to not in states or new[:2] < states[to][:2]:
                    states[to] = new
        return states

    states = insert({0: (0, "", "")})
    for role, text, fault in rows:
        new = {}

        def put(to, value, new=new):
            if to not in new or value[:2] < new[to][:2]:
                new[to] = value

        for s, (c, audit, done) in states.items():
            put(s, (c + 3, audit + "D", done))
            if fault in (1, 2):
                continue
            extra = fault == 3
            nl = "\n" * (s > 0)
            to, own = (2, "user") if s in (0, 1, 3) else (3, "assistant")
            if role[:1] == "s" and s == 0:
                put(1, (c + extra, audit + "K", f"{role}:{text}"))
            if role[:1] == own[0]:
                put(to, (c + extra, audit + "K", done + nl + f"{role}:{text}"))
            put(to, (c + 2 + extra, audit + "R", done + nl + f"{own}:{text}"))
        states = insert(new)
    return min((states[s] for s in (0, 3) if s in states), key=lambda v: v[:2])


def exhaustive(rows):
    """Every edit string with at most two inserts at a place, for very short conversations."""
    best = None

    def go(k, state, cost, audit, text):
        nonlocal best
        if k == len(rows) and state in (0, 3) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, text)
        nl = "\n" * (state > 0)
        to, own = (2, "user") if state in (0, 1, 3) else (3, "assistant")
        if not audit.endswith("II"):
            go(k, to, cost + 2, audit + "I", text + nl + own + ":")
        if k == len(rows):
            return
        role, content, fault = rows[k]
        go(k + 1, state, cost + 3, audit + "D", text)
        if fault in (1, 2):
            return
        if role[:1] == "s" and state == 0:
            go(k + 1, 1, cost + (fault == 3), audit + "K", f"{role}:{content}")
        if role[:1] == own[0]:
            go(k + 1, to, cost + (fault == 3), audit + "K", text + nl + f"{role}:{content}")
        go(k + 1, to, cost + 2 + (fault == 3), audit + "R", text + nl + f"{own}:{content}")

    go(0, 0, 0, "", "")
    return best


def random_conversation(rng, n):
    return [(rng.choice(["system", "user", "user", "assistant", "tool", ""]), f"t{k}", rng.choice([0, 0, 0, 1, 2, 3])) for k in range(n)]


@pytest.mark.parametrize("modulus,nodes", [(conversations.MODULUS, 20_000), (7, 20_000), (conversations.MODULUS, 12), (3, 5)])
def test_repairs_by_plain_programming(modulus, nodes):
    """Also with hashes that nearly always collide, and with prefixes written out all the time."""
    rng = random.Random(modulus + nodes)
    for trial in range(250):
        rows = random_conversation(rng, trial % 40)
        repair = conversations.Repair(modulus, nodes)
        for k, (role, text, fault) in enumerate(rows):
            repair.add(k, role, text, fault)
        got, want = repair.result(), best_repairs(rows)
        assert (got["cost"], got["audit"], got["repaired_sha256"]) == (want[0], want[1], hashlib.sha256(want[2].encode()).hexdigest()), rows


def test_repairs_of_short_conversations_exhaustively():
    rng = random.Random(3)
    for trial in range(120):
        rows = random_conversation(rng, trial % 5)
        assert best_repairs(rows) == exhaustive(rows), rows


def test_memory_of_a_very_long_conversation():
    repair, rng = conversations.Repair(nodes=2_000), random.Random(1)
    for k, (role, text, fault) in enumerate(random_conversation(rng, 30_000)):
        repair.add(k, role, text, fault)
    assert len(repair.edits) < 5_000
    assert len(repair.result()["audit"].replace("I", "")) == 30_000


def plain_audits(rows):
    """The whole contract for rows (conv_id, turn, role, text) in plain Python."""
    damaged = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = damaged.setdefault(conv, [])
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in damaged.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, messages, faults = set(), [], Counter()
        for _, role, text in kept:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            messages.append((role, text, fault))
        turns = {t for t, _, _ in kept if t is not None}
        cost, audit, repaired = best_repairs(messages)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults[1], faults[2], faults[3],
            sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(messages, messages[1:], strict=False)),
            cost, audit, hashlib.sha256(repaired.encode()).hexdigest(),
        )
    return out


AUDIT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def audits(df):
    rows = df.collect()
    found = {r["conv_id"]: tuple(r[c] for c in AUDIT) for r in rows}
    assert len(found) == len(rows)
    return found


def test_audits_of_the_table(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert audits(conversations.audit_conversations(conversations.damage(table), F.col("present"))) == plain_audits(rows)


def test_audits_of_odd_rows(spark):
    rng = random.Random(8)
    texts = ["Yes.", "No", None, "", " \t\n", "é!\r\n", "Ok? ", "\x0b\x0c.", "a\n.\n", "x" * 50_000 + "."]
    rows = [
        (rng.choice([None, 1, 2, 3, -7]), rng.choice([None, 0, 1, 2, 9, 40]), rng.choice(["user", "assistant", "system", None, "", "tool"]), rng.choice(texts))
        for _ in range(300)
    ]
    rows += [(100 + k, k % 3, "user", "Hello there.") for k in range(60)] + [(5, 1, "assistant", "One.")] * 7
    extra = ["present", "seen", "fault", "audit", "copy"]
    df = spark.createDataFrame([(*r, *("x" for _ in extra)) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in extra))
    assert audits(conversations.audit_conversations(conversations.damage(df), F.col("present"))) == plain_audits(rows)
    assert conversations.audit_conversations(conversations.damage(df.limit(0)), F.col("present")).collect() == []


def test_repaired_messages_match_their_checksum(spark):
    table = conversations.damage(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    want = {r["conv_id"]: r["repaired_sha256"] for r in conversations.audit_conversations(table, F.col("present")).collect()}
    texts = {c: [] for c in want}
    for r in conversations.repair_conversations(table, F.col("present")).orderBy("conv_id", "turn").collect():
        texts[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in texts.items()} == want


# byte-level BPE

@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_digest(library, text):
    ids = library.encode_ordinary(text or "")
    raw = b"".join(k.to_bytes(4, "little") for k in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


BPE = ("n_tokens", "ids_sha256", "decoded_sha256")


@pytest.mark.parametrize("chunk,overlap", [(byte_bpe.CHUNK, byte_bpe.OVERLAP), (64, 24), (40, 16)])
def test_ids_as_the_library_encodes_them(spark, library, chunk, overlap):
    texts = TEXTS + random_texts(200) + random_texts(100, "a  \n\n\tb's ", seed=9, most=400) + [
        "word " * 100, "y" * 1000 + " z", ("\n" * 90 + "x") * 5, "it's we're they'll " * 30, " " * 500 + "end", "tail " * 50 + "q" * 300 + " and " * 40, None,
    ]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    encoded = byte_bpe.encode(docs, chunk=chunk, overlap=overlap)
    rows = byte_bpe.digests(encoded).orderBy("doc_id").collect()
    for text, row in zip(texts, rows, strict=True):
        assert tuple(row[c] for c in BPE) == bpe_digest(library, text), repr(text)
    if chunk < 65_536:
        assert encoded.filter("row < 0").groupBy("row").count().agg({"count": "max"}).first()[0] > 3


def test_decoded_bytes_are_the_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    encoded = byte_bpe.encode(docs, chunk=2000, overlap=200)
    parts = {}
    for r in byte_bpe.decode(encoded).orderBy("part").collect():
        parts.setdefault(r["doc_id"], []).append(bytes(r["bytes"]))
    assert {d: b"".join(p).decode() for d, p in parts.items()} == {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_documents_as_the_library_encodes_them(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r["doc_id"]: bpe_digest(library, r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: tuple(r[c] for c in BPE) for r in byte_bpe.digests(byte_bpe.encode(docs)).collect()} == want
