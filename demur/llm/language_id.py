"""Language of a text by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. A word's
probability is the sum over all ways to cut it into pieces, by the forward algorithm; a
text's is the product over its words. The probabilities are learned by
expectation-maximisation: with forward and backward sums, each round adds up the expected
uses of every piece over the words of the training texts. The rounds are Spark jobs over a
table of word counts, whose results have one row per language and piece of the vocabulary.

All lower-case pieces of the vocabulary take part, whatever their length, and no word is cut:
the sums are carried along it, scaled as they go. A very long word is summed in blocks side by
side, each as a linear map of what earlier pieces reach into it, and the maps are chained.

Training reads ``TRAIN_ROWS`` documents of each language at most (smallest hash of the id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.llm.common import checksum_part, forget, id_and_text, small_batches, stored

TRAIN_ROWS = 1500
ROUNDS = 3
FOLDS, HELD_OUT_FOLD = 5, 0
UNDETERMINED = "und"
#: letters of the blocks of a word that has more than four of them
BLOCK = 64
#: sums are scaled after so many letters
SCALED_AFTER = 8
#: cached words, at about 150 bytes each
MAX_WORDS = 400_000
#: added to every expected count, and given to a letter that is no piece
SMOOTHING = 0.05

_BASE = np.uint64(1_000_003)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 18
_EDGE = "▁"  # the mark for the start of a word in the vocabulary
_STRIP = "".join(chr(c) for c in range(0x21, 0x100) if not chr(c).isalpha()) + "–—‘’“”…"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """Pieces of the vocabulary in lower case that a word can have: the mark of its start comes first, if at all."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)) and piece and piece == piece.lower() and _EDGE not in piece[1:]:
            found.add(piece)
    return sorted(found)


class PieceTable:
    """Pieces found by a hash of their letters."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.key = np.zeros(1 << _BITS, dtype=np.uint64)
        self.number = np.full(1 << _BITS, -1, dtype=np.int32)
        with np.errstate(over="ignore"):
            for number, piece in enumerate(pieces):
                h = np.uint64(0)
                for c in piece:
                    h = h * _BASE + np.uint64(ord(c) + 1)
                slot = int((h * _MIX) >> np.uint64(64 - _BITS))
                while self.number[slot] >= 0:
                    slot = (slot + 1) & ((1 << _BITS) - 1)
                self.key[slot], self.number[slot] = h, number

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, -1 where there is none."""
        slot = ((h * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)
        out = self.number[slot].copy()
        open_ = np.flatnonzero((out >= 0) & (self.key[slot] != h))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << _BITS) - 1)
            out[open_] = self.number[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.key[slot[open_]] != h[open_])]
        return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and letter codes of the words, those of one length together."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        letters = np.frombuffer("".join([words[i] for i in at]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        yield at, letters.reshape(len(at), size)


class Unigrams:
    """Piece probabilities of each language (rows: pieces, and last the unknown letter)."""

    def __init__(self, table: PieceTable, probability: np.ndarray):
        self.table = table
        self.probability = np.ascontiguousarray(probability, dtype=np.float64)

    def _from(self, codes: np.ndarray, i: int, stop: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Ends and piece numbers (-1: none) of the pieces that start at a place; a single letter always is one."""
        n, size = codes.shape
        h = np.zeros(n, dtype=np.uint64)
        for j in range(i, min(size if stop is None else stop, i + self.table.longest)):
            with np.errstate(over="ignore"):
                h = h * _BASE + codes[:, j]
            number = self.table.find(h)
            if j == i:
                number = np.where(number < 0, self.table.size, number)
            if (number >= 0).any():
                yield j + 1, number

    def _padded(self) -> np.ndarray:
        return np.vstack([self.probability, np.zeros((1, self.probability.shape[1]))])

    def _logs(self, codes: np.ndarray) -> np.ndarray:
        """Logarithm of the sum over all segmentations, for words of one length (rows), per language."""
        p = self._padded()  # number -1 is the last row: zero
        n, size = codes.shape
        reached: dict[int, np.ndarray] = {0: np.ones((n, p.shape[1]))}
        scale = np.zeros((n, p.shape[1]))
        for i in range(size):
            own = reached.pop(i)
            if i % SCALED_AFTER == SCALED_AFTER - 1:
                own = np.maximum(own, 1e-300)
                for j in reached:
                    reached[j] = reached[j] / own
                scale += np.log(own)
                own = np.ones_like(own)
            for j, number in self._from(codes, i):
                more = own * p[number]
                reached[j] = reached[j] + more if j in reached else more
        return np.log(np.maximum(reached[size], 1e-300)) + scale

    def _blocks(self, codes: np.ndarray) -> tuple[int, int]:
        """Number and width of the blocks of one very long word; what is left has ``longest`` letters at least."""
        width = max(BLOCK, self.table.longest)
        return max(0, (len(codes) - self.table.longest) // width), width

    def _maps(self, codes: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per block of one very long word: what it makes of the sums that earlier pieces reach
        into it (after, before, language), and the logarithm of the scale per language."""
        reach, languages = self.table.longest, p.shape[1]
        blocks, width = self._blocks(codes)
        for lo in range(0, blocks, 64):
            some = range(lo, min(blocks, lo + 64))
            rows = np.stack([codes[k * width: (k + 1) * width + reach] for k in some])
            state = np.zeros((width + reach, len(some), reach, languages))  # reached from each entry
            for e in range(reach):
                state[e, :, e] = 1.0
            grown = np.zeros((len(some), languages))
            for i in range(width):
                for j, number in self._from(rows, i):
                    state[j] += state[i] * p[number][:, None, :]
                if i % SCALED_AFTER == SCALED_AFTER - 1:
                    largest = np.maximum(state[i + 1:].max(axis=(0, 2)), 1e-300)
                    state[i + 1:] /= largest[None, :, None, :]
                    grown += np.log(largest)
            for k in range(len(some)):
                yield state[width: width + reach, k], grown[k]

    def _long_log(self, codes: np.ndarray) -> np.ndarray:
        """The same for one very long word, per language, by chaining the maps of its blocks."""
        p, reach = self._padded(), self.table.longest
        blocks, width = self._blocks(codes)
        vector, scale = np.zeros((p.shape[1], reach)), np.zeros(p.shape[1])
        vector[:, 0] = 1.0
        for block, grown in self._maps(codes, p):
            vector = np.einsum("abl,lb->la", block, vector)
            total = np.maximum(vector.sum(axis=1), 1e-300)
            vector /= total[:, None]
            scale += np.log(total) + grown
        rest = codes[blocks * width:][None, :]
        reached = {k: vector[None, :, k] for k in range(reach)}
        for i in range(rest.shape[1]):
            own = reached.pop(i)
            if i % SCALED_AFTER == SCALED_AFTER - 1:
                largest = np.maximum(np.maximum.reduce([own, *reached.values()]), 1e-300)
                own, reached = own / largest, {j: r / largest for j, r in reached.items()}
                scale += np.log(largest[0])
            for j, number in self._from(rest, i):
                more = own * p[number]
                reached[j] = reached[j] + more if j in reached else more
        return np.log(np.maximum(reached[rest.shape[1]][0], 1e-300)) + scale

    def log_probability(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.probability.shape[1]))
        for at, letters in _by_length([_EDGE + w for w in words]):
            codes = letters.astype(np.uint64) + np.uint64(1)
            if codes.shape[1] > 4 * max(BLOCK, self.table.longest):
                for k, word in zip(at, codes, strict=True):
                    out[k] = self._long_log(word)
                continue
            step = max(1, min(20_000, 800_000 // codes.shape[1]))
            for lo in range(0, len(at), step):
                out[at[lo: lo + step]] = self._logs(codes[lo: lo + step])
        return out

    def expected_uses(self, words: list[str], language: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is used, over all segmentations of each word in its language."""
        uses = np.zeros((self.table.size + 1, self.probability.shape[1]))
        for at, letters in _by_length([_EDGE + w for w in words]):
            codes = letters.astype(np.uint64) + np.uint64(1)
            size = codes.shape[1]
            if size > 4 * max(BLOCK, self.table.longest):
                for k, word in zip(at, codes, strict=True):
                    self._add_long(uses, word, language[k: k + 1], counts[k: k + 1])
                continue
            for lo in range(0, len(at), 10_000):
                some = at[lo: lo + 10_000]
                edge = np.zeros((1, len(some)))
                self._add_uses(uses, codes[lo: lo + 10_000], size, language[some], counts[some], edge, edge)
        return uses

    def _add_uses(self, uses, rows, width: int, own, counts, before: np.ndarray, after: np.ndarray) -> None:
        """Add the uses of pieces that start in the first ``width`` letters, in logarithms of sums.

        ``before``: what earlier pieces reach, at the first places; ``after``: what follows, from place ``width`` on.
        """
        p = self._padded()
        forward = np.full((width + max(len(after), 1), len(rows)), -np.inf)
        backward = forward.copy()
        forward[: len(before)] = before
        backward[width: width + len(after)] = after
        with np.errstate(divide="ignore", invalid="ignore"):
            for i in range(width):
                for j, number in self._from(rows, i):
                    forward[j] = np.logaddexp(forward[j], forward[i] + np.log(p[number, own]))
            uses_of = []
            for i in range(width - 1, -1, -1):
                for j, number in self._from(rows, i):
                    rest = np.log(p[number, own]) + backward[j]
                    backward[i] = np.logaddexp(backward[i], rest)
                    found = np.flatnonzero(number >= 0)
                    uses_of.append((number[found], found, (forward[i] + rest)[found]))
            whole = np.logaddexp.reduce(before + backward[: len(before)], axis=0)
            for number, found, log in uses_of:
                np.add.at(uses, (number, own[found]), np.exp(log - whole[found]) * counts[found])

    def _add_long(self, uses, codes: np.ndarray, own: np.ndarray, count: np.ndarray) -> None:
        """One very long word: sums at the borders of its blocks by their maps, then all blocks side by side."""
        reach = self.table.longest
        blocks, width = self._blocks(codes)
        maps = [m[:, :, 0] for m, _ in self._maps(codes, self._padded()[:, own])]
        before, after = np.zeros((blocks + 1, reach)), np.zeros((blocks + 1, reach))
        before[0, 0] = 1.0
        for k in range(blocks):
            before[k + 1] = maps[k] @ before[k]
            before[k + 1] /= max(before[k + 1].sum(), 1e-300)
        rest = codes[blocks * width:][None, :]
        n = rest.shape[1]
        ends = np.full((n + 1, 1), -np.inf)
        ends[n] = 0.0
        p = self._padded()
        with np.errstate(divide="ignore"):
            for i in range(n - 1, -1, -1):
                for j, number in self._from(rest, i):
                    ends[i] = np.logaddexp(ends[i], np.log(p[number, own]) + ends[j])
            after[blocks] = np.exp(ends[:reach, 0] - ends[:reach, 0].max())
            for k in range(blocks - 1, -1, -1):
                after[k] = maps[k].T @ after[k + 1]
                after[k] /= max(after[k].max(), 1e-300)
            self._add_uses(uses, rest, n, own, count, np.log(before[blocks])[:, None], np.zeros((1, 1)))
            for lo in range(0, blocks, 1000):
                some = range(lo, min(blocks, lo + 1000))
                rows = np.stack([codes[k * width: (k + 1) * width + reach] for k in some])
                each = np.full(len(some), own[0]), np.full(len(some), count[0])
                self._add_uses(uses, rows, width, *each, np.log(before[lo: some.stop]).T, np.log(after[lo + 1: some.stop + 1]).T)


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in lower case without marks at their ends, and whose they are."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    words = pc.utf8_trim(lists.flatten(), characters=_STRIP)
    offsets = lists.offsets.to_numpy()
    return words, np.repeat(np.arange(len(texts)), np.diff(offsets))


class Identifier:
    def __init__(self, languages: list[str], pieces: list[str], probability: np.ndarray):
        self.languages, self.pieces, self.probability = languages, pieces, probability
        self._ready = None

    def __getstate__(self):
        return self.languages, self.pieces, self.probability

    def __setstate__(self, state):
        self.__init__(*state)

    def _prepare(self):
        if self._ready is None:
            self._ready = Unigrams(PieceTable(self.pieces), self.probability)
            self._rows: dict[str, int] = {}
            self._logs = np.zeros((1024, len(self.languages)), dtype=np.float32)
        return self._ready

    def _word_logs(self, words: list[str]) -> np.ndarray:
        unigrams = self._prepare()
        if len(self._rows) + len(words) > MAX_WORDS:
            self._rows.clear()
        new = [w for w in words if w not in self._rows]
        if new:
            logs = unigrams.log_probability(new)
            first = len(self._rows)
            if first + len(new) > len(self._logs):
                grown = np.zeros((2 * (first + len(new)), len(self.languages)), dtype=np.float32)
                grown[:first] = self._logs[:first]
                self._logs = grown
            self._logs[first: first + len(new)] = logs
            self._rows.update(zip(new, range(first, first + len(new)), strict=True))
        rows = self._rows
        return self._logs[np.fromiter((rows[w] for w in words), dtype=np.int64, count=len(words))]

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Likeliest language of every text and its posterior under equal priors."""
        words, of = text_words(texts)
        encoded = words.dictionary_encode()
        logs = self._word_logs(encoded.dictionary.to_numpy(zero_copy_only=False).tolist())
        index = encoded.indices.to_numpy(zero_copy_only=False)
        n = len(texts)
        total = np.stack([np.bincount(of, weights=logs[index, k], minlength=n) for k in range(len(self.languages))], axis=1)
        best = total.argmax(axis=1)
        posterior = 1 / np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, posterior, 0.0)


def _start(pieces: list[str], languages: int) -> np.ndarray:
    """Short pieces likelier than long ones; equal for all languages."""
    weight = np.array([0.3 ** len(p) for p in pieces] + [1e-7])
    return np.repeat((weight / weight.sum())[:, None], languages, axis=1)


def train(docs: DataFrame, vocabulary: str | None = None, rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> Identifier:
    """Piece probabilities of every language among the training documents (null lang left out)."""
    spark = docs.sparkSession
    pieces = read_pieces(vocabulary or vocabulary_path())
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    known = known.filter("doc_id is not null and lang is not null").filter(checksum_part("doc_id", FOLDS) != HELD_OUT_FOLD).distinct()
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())  # the labels to learn
    if not languages:
        return Identifier([UNDETERMINED], pieces, _start(pieces, 1))
    chosen = None
    for lang in languages:  # the best of each task, then of all: no task ranks a whole language
        some = known.filter(F.col("lang") == lang).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most ``rows`` ids of each language
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    texts = texts.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")
    number = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            words, of = text_words(batch.column("text"))
            own = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int32)[of]
            seen = pa.table({"language": own, "word": words}).group_by(["language", "word"]).aggregate([([], "count_all")])
            yield from seen.select(["language", "word", "count_all"]).rename_columns(["language", "word", "n"]).to_batches()

    counted = texts.mapInArrow(count, "language int, word string, n long").filter("word != ''")
    counted = stored(counted.groupBy("language", "word").agg(F.sum("n").alias("n")), "words")
    probability = _start(pieces, len(languages))
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((pieces, probability))

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            pieces, probability = model.value
            unigrams, uses = Unigrams(PieceTable(pieces), probability), np.zeros_like(probability)
            for batch in batches:
                own, n = batch.column("language").to_numpy(), batch.column("n").to_numpy()
                uses += unigrams.expected_uses(batch.column("word").to_pylist(), own, n.astype(np.float64))
            at, lang = np.nonzero(uses)
            yield pa.RecordBatch.from_pydict({"piece": at.astype(np.int32), "language": lang.astype(np.int32), "uses": uses[at, lang]})

        uses = counted.mapInArrow(expect, "piece int, language int, uses double").groupBy("piece", "language").agg(F.sum("uses").alias("uses"))
        table = uses.toPandas()  # pieces x languages at most
        fresh = np.full_like(probability, SMOOTHING)
        fresh[table["piece"].to_numpy(), table["language"].to_numpy()] += table["uses"].to_numpy()
        probability = fresh / fresh.sum(axis=0, keepdims=True)
        model.unpersist()
    forget(counted)
    return Identifier(languages, pieces, probability)


def identify(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row.

    ``und`` with score 0 for a text that is null or has no letter. Ties go to the language
    first in the alphabet. Without any labelled training row every prediction is ``und``.
    """
    identifier = docs.sparkSession.sparkContext.broadcast(train(docs, vocabulary))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            names, scores = identifier.value.score(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": names, "score": scores})

    held_out = F.coalesce(checksum_part("doc_id", FOLDS) == HELD_OUT_FOLD, F.lit(False))
    predicted = id_and_text(docs).mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
