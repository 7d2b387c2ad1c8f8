"""Hashed word shingles of a batch of texts.

A word is what stands between white space, in lower case, without marks at its ends. A
shingle is five words in a row; a text with one to four words has one shingle of all of
them, a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SIZE = 5
#: trimmed from both ends of a word: the ASCII marks
MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every bit depends on every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and where each text's words start."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    words = pc.utf8_trim(lists.flatten(), characters=MARKS)
    encoded = words.dictionary_encode()
    of_word = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) if w else 0 for w in encoded.dictionary.to_numpy(zero_copy_only=False).tolist()),
        dtype=np.uint64, count=len(encoded.dictionary),
    )
    index = encoded.indices.to_numpy(zero_copy_only=False)
    hashes = of_word[index] if len(index) else np.zeros(0, dtype=np.uint64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    kept = hashes != 0
    if not kept.all():
        before = np.concatenate([[0], np.cumsum(kept)])
        hashes, offsets = hashes[kept], before[offsets]
    return hashes, offsets


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in a row, and where each text's shingles start."""
    n_words = np.diff(offsets)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    starts = np.concatenate([[0], np.cumsum(n)])
    total = int(starts[-1])
    if not total:
        return np.zeros(0, dtype=np.uint64), starts
    doc = np.repeat(np.arange(len(n)), n)
    first = np.arange(total) - starts[doc] + offsets[doc]
    padded = np.concatenate([hashes, np.zeros(size, dtype=np.uint64)])
    out = np.zeros(total, dtype=np.uint64)
    last = offsets[doc + 1]
    with np.errstate(over="ignore"):
        for k in range(size):
            word = np.where(first + k < last, padded[first + k], np.uint64(0))
            out = mixed(out * _MULTIPLIER + word + np.uint64(1)) if k == size - 1 else out * _MULTIPLIER + word + np.uint64(1)
    return out, starts


def shingles(texts: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    return shingle_hashes(*word_hashes(texts), size)


def counted(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text in ascending order: text number, hash, count."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(hashes)))
