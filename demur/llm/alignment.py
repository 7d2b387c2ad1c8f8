"""Tokens of two tokenizers lined up on the same bytes, by diagonal run skipping.

Both tokenizers cut the same bytes (a space and the text), so each gives a rising array of
byte ends. At a current shift between the indices of the two arrays, equal slices are probed
at one, two, four, ... ends at a time; where a slice differs the step is halved again, so a
stretch of one-to-one tokens of any length costs a logarithm of probes. Where the ends
differ, the two arrays are walked until they meet; that irregular group changes the shift,
and probing goes on from there.

Two passes. The first encodes, aligns and keeps per document its totals and its different
(A id, B id) links with how often each occurs; equal links are counted over the corpus. The
second looks the counts up again: links that occur often are few and are broadcast, at most
``FREQUENT`` of them; all others meet the documents in a join, in which by construction no
key is frequent.

Texts are taken apart into *units*, from one space between visible characters to the next.
Neither tokenizer joins anything across such a place (`Encoders` refuses vocabularies that
could), so both have an end there. The units of a batch that are not known yet are put in a
row and lined up in one go; what was found is held per unit in a bounded cache. Very long
texts are aligned a slice at a time.

Null and empty texts, and texts that one of the tokenizers doesn't reproduce byte for byte,
have no tokens: zeros and an empty digest. One row per row: repeated rows and null ids are
rows of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.llm.common import id_and_text, release_memory, small_batches, stored
from demur.llm.words import gathered, vocabulary_path

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: links whose counts are broadcast
FREQUENT = 500_000
#: texts are sliced into about this many characters, and so many are aligned at a time
SLICE_CHARS = 400_000
#: units of a generation of a worker's cache, at about 300 bytes each; two are held
MAX_UNITS = 300_000

MARK = "▁"
SCHEMA = """row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,
    links array<struct<pair: long, times: long>>"""

# a space between visible characters; what Python calls white space covers what the tokenizers do
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WHITE = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = f"(^|{_WHITE}) | ({_WHITE}|$)"

#: tokens of A, tokens of B, groups, the groups as text, linked pairs as bytes, bytes kept
Unit = tuple[int, int, int, str, bytes, bool]
NOT_KEPT: Unit = (0, 0, 0, "", b"", False)

_encoders: dict[tuple[str, str], Encoders] = {}


def encoders(path_a: str, path_b: str) -> Encoders:
    """One pair per Python worker, which keeps its cache from task to task."""
    if (path_a, path_b) not in _encoders:
        _encoders[path_a, path_b] = Encoders(path_a, path_b)
    return _encoders[path_a, path_b]


def byte_of_symbol() -> dict[str, int]:
    """The symbols under which a byte-level vocabulary writes its bytes: printable ones of
    Latin-1 stand for themselves, the others for the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoders:
    """Both tokenizers, the bytes of their ids, and a bounded cache of encoded units."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        symbols = byte_of_symbol()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for piece, ident in self.a.get_vocab().items():
            self.bytes_a[ident] = bytes(symbols[s] for s in piece) if all(s in symbols for s in piece) else piece.encode()
        pieces = [self.b.id_to_piece(k) for k in range(len(self.b))]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece joins two words, so texts cannot be encoded in units")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)
        ]
        self.size_a = np.fromiter(map(len, self.bytes_a), dtype=np.int64, count=len(self.bytes_a))
        self.size_b = np.fromiter(map(len, self.bytes_b), dtype=np.int64, count=len(self.bytes_b))
        self.names = [str(k) for k in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.young: dict[str, Unit] = {}
        self.old: dict[str, Unit] = {}

    def _kept(self, ids: list[list[int]], table: list[bytes], raw: list[bytes]) -> list[bool]:
        """Which units' tokens join to the unit's own bytes."""
        return [b"".join([table[k] for k in of_unit]) == own for of_unit, own in zip(ids, raw, strict=True)]

    def _align(self, units: list[str]) -> dict[str, Unit]:
        """Encode units, put the tokens of all of them in a row, and line these up. Units are groups' borders."""
        of_a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        of_b = self.b.encode([u[1:] for u in units], num_threads=1)  # which adds the first space by itself
        raw = [u.encode() for u in units]
        kept_a, kept_b = self._kept(of_a, self.bytes_a, raw), self._kept(of_b, self.bytes_b, raw)
        out = {u: NOT_KEPT for u, a, b in zip(units, kept_a, kept_b, strict=True) if not (a and b)}
        if out:
            good = [u not in out for u in units]
            units, of_a, of_b = ([x for x, g in zip(side, good, strict=True) if g] for side in (units, of_a, of_b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(side), dtype=np.int64) for side in (of_a, of_b))
        stretches, links_a, links_b = align(np.cumsum(self.size_a[ids_a]).tolist(), np.cumsum(self.size_b[ids_b]).tolist())
        names = self.names
        groups, ends = groups_of(stretches, [names[k] for k in ids_a.tolist()], [names[k] for k in ids_b.tolist()])
        at_a = np.array(links_a, dtype=np.int64)
        pairs = ids_b[np.array(links_b, dtype=np.int64)] * len(self.bytes_a) + ids_a[at_a]
        # tokens of A tell where each unit's groups and links end
        last = np.cumsum(np.fromiter(map(len, of_a), dtype=np.int64, count=len(of_a)))
        to_group = np.searchsorted(np.array(ends, dtype=np.int64), last, "right").tolist()
        to_link = np.searchsorted(at_a, last, "left").tolist()
        g = n = 0
        for unit, a, b, g_end, n_end in zip(units, of_a, of_b, to_group, to_link, strict=True):
            out[unit] = (len(a), len(b), g_end - g, ";".join(groups[g:g_end]), pairs[n:n_end].tobytes(), True)
            g, n = g_end, n_end
        return out

    def aligned_units(self, units: list[str]) -> list[Unit]:
        """What is known of different units, aligned now or before."""
        if len(self.young) > MAX_UNITS:  # what was not asked for since then goes
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = self._align([u for u in units if u not in young and u not in old])
        found = [young.get(u) or old.get(u) or new[u] for u in units]
        young.update((u, f) for u, f in zip(units, found, strict=True) if len(u) <= 64)
        return found


def units_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where each text's units start, and the units of all texts."""
    odd = pc.match_substring_regex(texts, _ODD)
    lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    units = pc.binary_join_element_wise("", lists.flatten(), " ")
    starts = lists.offsets.to_numpy().astype(np.int64)
    if pc.any(odd).as_py():
        plain, every, counts = units.to_pylist(), [], []
        for k, strange in enumerate(odd.to_pylist()):
            found = [" " + u for u in _CUT.split(texts[k].as_py())] if strange else plain[starts[k]: starts[k + 1]]
            every += found
            counts.append(len(found))
        units, starts = pa.array(every, pa.string()), np.concatenate([[0], np.cumsum(counts)])
    return starts, units.dictionary_encode()


def slices(text: str, chars: int = SLICE_CHARS) -> Iterator[str]:
    """A text in slices that start where units do; the space before each later slice is left out."""
    start = 0
    while len(text) - start > chars:
        cut = _CUT.search(text, start + chars)
        if cut is None:
            break
        yield text[start: cut.start()]
        start = cut.end()
    yield text[start:]


def align(a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int, int, bool]], list[int], list[int]]:
    """Line up two rising lists of byte ends whose last values are equal.

    Gives the stretches (A from, A to, B from, B to, one-to-one) in order - an irregular one is
    one group, a one-to-one stretch has a group per token - and the links as two lists of indices.
    """
    stretches: list[tuple[int, int, int, int, bool]] = []
    of_a: list[int] = []
    of_b: list[int] = []
    i = shift = 0
    n = len(a)
    while i < n:
        start, step = i, 1
        while a[i: i + step] == b[i + shift: i + shift + step]:
            i += step
            if i >= n:
                i = n
                break
            step *= 2
        else:
            while step > 1:
                step >>= 1
                if a[i: i + step] == b[i + shift: i + shift + step]:
                    i += step
        if i > start:
            stretches.append((start, i, start + shift, i + shift, True))
            of_a.extend(range(start, i))
            of_b.extend(range(start + shift, i + shift))
            if i >= n:
                break
        start, j = i, i + shift
        first, x, y = j, a[i], b[j]
        while x != y:
            of_a.append(i)
            of_b.append(j)
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        of_a.append(i)
        of_b.append(j)
        i += 1
        j += 1
        stretches.append((start, i, first, j, False))
        shift = j - i
    return stretches, of_a, of_b


def groups_of(stretches, a: list[str], b: list[str]) -> tuple[list[str], list[int]]:
    """The groups as text, ids of A, a bar and ids of B, and the index of A after each."""
    out: list[str] = []
    ends: list[int] = []
    for i, i_end, j, j_end, single in stretches:
        if single:
            out += [f"{x}|{y}" for x, y in zip(a[i:i_end], b[j:j_end])]  # noqa: B905
            ends.extend(range(i + 1, i_end + 1))
        else:
            out.append(",".join(a[i:i_end]) + "|" + ",".join(b[j:j_end]))
            ends.append(i_end)
    return out, ends


class Document:
    """Sums over the slices of one document."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.digest = hashlib.sha256()
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.whole = True

    def add(self, n_a: int, n_b: int, n_groups: int, groups: str, pairs: np.ndarray) -> None:
        if self.n_groups:
            self.digest.update(b";")
        self.digest.update(groups.encode())
        self.n_a, self.n_b = self.n_a + n_a, self.n_b + n_b
        self.n_groups, self.n_links = self.n_groups + n_groups, self.n_links + len(pairs)
        self.pairs.append(np.unique(pairs, return_counts=True))
        if len(self.pairs) > 32:
            self.pairs = [self.links()]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Different pairs and how often each is linked."""
        if len(self.pairs) == 1:
            return self.pairs[0]
        if not self.pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pair, back = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
        return pair, np.bincount(back, weights=np.concatenate([t for _, t in self.pairs])).astype(np.int64)


def align_texts(coder: Encoders, texts: list[str | None]) -> list[Document]:
    """Align whole texts. Short ones are taken together, long ones slice by slice."""
    documents = [Document() for _ in texts]
    parts = [(d, s) for d, text in zip(documents, texts, strict=True) if text for s in slices(text)]
    at = 0
    while at < len(parts):
        end, chars = at, 0
        while end < len(parts) and (end == at or chars + len(parts[end][1]) <= SLICE_CHARS):
            chars += len(parts[end][1])
            end += 1
        starts, units = units_of(pa.array([s for _, s in parts[at:end]], pa.string()))
        found = coder.aligned_units(units.dictionary.to_pylist())
        index = units.indices.to_numpy().astype(np.int64)
        sums = [np.concatenate([[0], np.cumsum(np.array([f[c] for f in found], dtype=np.int64)[index])])[starts] for c in (0, 1, 2, 5)]
        n_a, n_b, n_groups, good = (np.diff(x).tolist() for x in sums)
        raw = [f[4] for f in found]
        pool, sizes = np.frombuffer(b"".join(raw), dtype=np.int64), np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 8
        pairs, each = gathered(pool, sizes, index)
        links = np.concatenate([[0], np.cumsum(each)])[starts].tolist()
        groups, order, starts = [f[3] for f in found], index.tolist(), starts.tolist()
        for k in range(end - at):
            document = parts[at + k][0]
            document.whole = document.whole and good[k] == starts[k + 1] - starts[k]
            if document.whole:
                text = ";".join([groups[u] for u in order[starts[k]: starts[k + 1]]])
                document.add(n_a[k], n_b[k], n_groups[k], text, pairs[links[k]: links[k + 1]])
        at = end
    return documents


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoders(path_a, path_b)
        number = TaskContext.get().partitionId() << 40
        for batch in small_batches(batches, chars=SLICE_CHARS, rows=1000):
            documents = align_texts(coder, batch.column("text").to_pylist())
            columns: dict[str, list] = {n: [] for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            pairs, times, ends = [], [], [0]
            for d in documents:
                d = d if d.whole else Document()
                for name in ("n_a", "n_b", "n_groups", "n_links"):
                    columns[name].append(getattr(d, name))
                columns["groups_sha256"].append(d.digest.hexdigest() if d.n_links else "")
                pair, count = d.links()
                pairs.append(pair)
                times.append(count)
                ends.append(ends[-1] + len(pair))
            links = pa.StructArray.from_arrays([pa.array(np.concatenate(pairs)), pa.array(np.concatenate(times))], ["pair", "times"])
            rows = np.arange(number, number + batch.num_rows)
            number += batch.num_rows
            arrays = [pa.array(rows), batch.column("doc_id"), *(pa.array(columns[n], pa.int64()) for n in list(columns)[:4])]
            arrays += [pa.array(columns["groups_sha256"], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), links)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", *columns, "links"])
        release_memory()

    return run


def aligned_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per document its totals, the digest of its groups, and its different links with their number.

    A link's pair is B id * (number of ids of A) + A id.
    """
    path_a, path_b = path_a or vocabulary_path(VOCABULARY_A), path_b or vocabulary_path(VOCABULARY_B)
    return id_and_text(docs).mapInArrow(_aligned(path_a, path_b), SCHEMA)


def link_counts(aligned: DataFrame, size_a: int) -> DataFrame:
    """Over all documents: ``pair``, ``n`` (how often linked), ``best`` (no A id is linked more often to this B id)."""
    counts = stored(aligned.select(F.inline("links")).groupBy("pair").agg(F.sum("times").alias("n")), "link-counts")
    of_b = F.expr(f"pair div {size_a}")
    highest = counts.groupBy(of_b.alias("of_b")).agg(F.max("n").alias("highest"))  # a row per id of B at most
    return counts.join(F.broadcast(highest), of_b == F.col("of_b")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def frequency_limit(counts: DataFrame, most: int) -> tuple[int, bool]:
    """A count that at most ``most`` links reach, and whether all links do. Sends 64 rows to the driver at most."""
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().orderBy(F.desc("level")).collect()
    limit, reached = 1 << 62, 0
    for r in levels:
        reached += r["count"]
        if reached > most:
            return limit, False
        limit = 1 << r["level"]
    return limit, True


def align_tokens(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per row.

    ``n_best``: links whose pair is the most frequent of its B id in the corpus, ties included;
    ``count_sum``: corpus counts of the pairs, summed over the links.
    """
    path_a, path_b = path_a or vocabulary_path(VOCABULARY_A), path_b or vocabulary_path(VOCABULARY_B)
    aligned = stored(aligned_documents(docs, path_a, path_b), "aligned")
    counts = stored(link_counts(aligned, vocabulary_size(path_a)), "link-counts")
    limit, covers_all = frequency_limit(counts, frequent)
    links = aligned.select("row", F.inline("links"))
    often = F.broadcast(counts.filter(F.col("n") >= limit))
    sums = [F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    parts = links.join(often, "pair").groupBy("row").agg(*sums)
    if not covers_all:
        seldom = links.join(often.select("pair"), "pair", "left_anti").join(counts.filter(F.col("n") < limit), "pair").groupBy("row").agg(*sums)
        parts = parts.unionByName(seldom).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    totals = aligned.drop("links").join(parts, "row", "left")
    return totals.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def vocabulary_size(path_a: str) -> int:
    """Ids of the first tokenizer, which the pair of a link is counted in."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path_a).get_vocab_size()
