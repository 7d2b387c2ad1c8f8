"""Token ids of the public word BPE, with every different word of a batch encoded once.

The tokenizer splits at white space, at the border between letters and other characters,
and encodes each part by itself. So a text's ids are the ids of its words in a row. Arrow
splits a batch of texts into words and finds the different ones; their parts are looked up
in a bounded cache, and what is not there goes to the library. Texts with unusual white
space, and words that are not plainly letters followed by punctuation, are handed to the
library as they are.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: cached parts of words, at about 200 bytes each
MAX_PARTS = 600_000

_ODD_SPACE = "[\x0b\x0c\x1c-\x1f\x85\xa0  -​    　﻿᠎]|<\\|"
_MARKS = ".,!?;:%$#*&|"
# letters of Latin-1 have no contextual forms; contractions start with an apostrophe
_LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isalpha() and c not in "ªºµ")

_encoders: dict[str, WordEncoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> WordEncoder:
    """One per Python worker, which keeps its cache from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def gathered(pool: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a pool, given by number, in a row; and the size of each."""
    starts = np.cumsum(sizes) - sizes
    each = sizes[index]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total, dtype=np.int64) + np.repeat(starts[index] - (ends - each), each)], each


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers, by the tokenizer alone."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if len(self.parts) >= MAX_PARTS:
            self.parts.clear()
        ids = self.library(part)
        if len(part) <= 64:
            self.parts[part] = ids
        return ids

    def _parts(self, parts: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        get, part = self.parts.get, self._part
        ids = [get(p) or part(p) for p in parts.dictionary.to_numpy(zero_copy_only=False).tolist()]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        return np.frombuffer(b"".join(ids), dtype="<u4"), sizes

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each of the different words, in a row, and how many each has."""
        core = pc.utf8_rtrim(words, characters=_MARKS)
        plain = pc.and_(pc.equal(pc.binary_length(pc.utf8_ltrim(core, characters=_LETTERS)), 0), pc.greater(pc.binary_length(core), 0))
        cores = pc.if_else(plain, pc.utf8_lower(core), words).dictionary_encode()
        marks = pc.if_else(plain, pc.utf8_ltrim(words, characters=_LETTERS), "").dictionary_encode()
        pool, sizes = self._parts(cores)
        more, more_sizes = self._parts(marks)
        both = np.empty(2 * len(words), dtype=np.int64)
        both[0::2] = cores.indices.to_numpy(zero_copy_only=False)
        both[1::2] = marks.indices.to_numpy(zero_copy_only=False) + len(sizes)
        ids, per_part = gathered(np.concatenate([pool, more]), np.concatenate([sizes, more_sizes]), both)
        return ids, per_part[0::2] + per_part[1::2]

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has. A null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        lists = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        words = lists.flatten().dictionary_encode()
        pool, sizes = self._words(words.dictionary)
        ids, per_word = gathered(pool, sizes, words.indices.to_numpy(zero_copy_only=False))
        offsets = lists.offsets.to_numpy()
        before = np.concatenate([[0], np.cumsum(per_word)])
        at = before[offsets - offsets[0]]
        lengths = at[1:] - at[:-1]
        if pc.any(odd).as_py():
            ids, lengths = self._with_odd(texts, odd, ids, lengths)
        return ids, lengths

    def _with_odd(self, texts, odd, ids, lengths):
        ends = np.cumsum(lengths)
        pieces = []
        lengths = lengths.copy()
        for i, strange in enumerate(odd.to_pylist()):
            piece = ids[ends[i] - lengths[i]: ends[i]]
            if strange:
                piece = np.frombuffer(self.library(texts[i].as_py()), dtype="<u4")
                lengths[i] = len(piece)
            pieces.append(piece)
        return np.concatenate(pieces), lengths
