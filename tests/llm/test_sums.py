"""Segmentation sums against sums over listed segmentations, and candidates of personal data."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from demur.llm import language_id, personal_data

PIECES = ["▁", "a", "b", "ab", "ba", "▁a", "abababababab", "bbb"]


def unigrams(languages=2, seed=1):
    rng = np.random.default_rng(seed)
    probability = rng.random((len(PIECES) + 1, languages)) + 0.01
    return language_id.Unigrams(language_id.PieceTable(PIECES), probability / probability.sum(axis=0))


def segmentations(text):
    """Every way to cut a text into pieces; a letter that is no piece stands for the last number."""
    if not text:
        yield ()
        return
    for k, piece in enumerate(PIECES):
        if text.startswith(piece):
            for rest in segmentations(text[len(piece):]):
                yield (k, *rest)
    if text[0] not in PIECES:
        for rest in segmentations(text[1:]):
            yield (len(PIECES), *rest)


def test_pieces_longer_than_eight_letters_take_part():
    pieces = language_id.read_pieces(language_id.vocabulary_path())
    assert sum(len(p) > 8 for p in pieces) > 2000 and max(map(len, pieces)) > 12


def test_sums_of_words_of_any_length():
    model, rng = unigrams(), random.Random(2)
    for n in (1, 5, 14):
        word = "".join(rng.choice("abx") for _ in range(n))
        want = [math.log(sum(math.prod(model.probability[k, lang] for k in s) for s in segmentations("▁" + word))) for lang in range(2)]
        assert model.log_probability([word])[0] == pytest.approx(want)
    # by blocks and letter by letter, far below the smallest double
    for n in (256, 257, 300, 1000, 4321):
        word = "".join(rng.choice("aabbx") for _ in range(n))
        codes = np.array([[ord(c) + 1 for c in "▁" + word]], dtype=np.uint64)
        assert model._long_log(codes[0]) == pytest.approx(model._logs(codes)[0], rel=1e-9)
        assert model.log_probability([word])[0] == pytest.approx(model._logs(codes)[0], rel=1e-9)


def test_one_round_of_expectation():
    model = unigrams()
    words, language, counts = ["ab", "abba", "xab", "babab", "ab"], np.array([0, 1, 0, 1, 1]), np.array([3.0, 1.0, 2.0, 5.0, 7.0])
    want = np.zeros_like(model.probability)
    for word, lang, n in zip(words, language, counts, strict=True):
        all_ways = list(segmentations("▁" + word))
        weight = np.array([math.prod(model.probability[k, lang] for k in s) for s in all_ways])
        for s, w in zip(all_ways, weight / weight.sum(), strict=True):
            for k in s:
                want[k, lang] += n * w
    assert model.expected_uses(words, language, counts) == pytest.approx(want)


def test_expectation_of_a_very_long_word():
    model = unigrams()
    uses = model.expected_uses(["ab" * 600], np.array([1]), np.array([2.0]))
    letters = sum(uses[k, 1] * len(p.replace("▁", "")) for k, p in enumerate(PIECES))
    assert letters == pytest.approx(2 * 1200) and np.isfinite(uses).all()


@pytest.mark.parametrize("n", [257, 300, 777])
def test_expectation_by_blocks(n):
    model, rng = unigrams(), random.Random(n)
    word = "".join(rng.choice("aabbx") for _ in range(n))
    codes = np.array([[ord(c) + 1 for c in "▁" + word]], dtype=np.uint64)
    by_blocks, plain = np.zeros_like(model.probability), np.zeros_like(model.probability)
    own, count, edge = np.array([1]), np.array([2.0]), np.zeros((1, 1))
    model._add_long(by_blocks, codes[0], own, count)
    model._add_uses(plain, codes, n + 1, own, count, edge, edge)
    assert by_blocks == pytest.approx(plain)


def test_predictions_by_listing():
    model = unigrams()
    identifier = language_id.Identifier(["x", "y"], PIECES, model.probability)
    texts = ["ab ba, abba!", "bbb ab", "12 34", "", None, "ABAB (ba) xab"]
    names, scores = identifier.score(pa.array(texts))
    for text, name, score in zip(texts, names, scores, strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0.0)
            continue
        words = [w.strip("().,!") for w in text.lower().split()]
        logs = [sum(math.log(sum(math.prod(model.probability[k, lang] for k in s) for s in segmentations("▁" + w))) for w in words) for lang in range(2)]
        assert name == "xy"[int(np.argmax(logs))]
        assert score == pytest.approx(1 / sum(math.exp(x - max(logs)) for x in logs), rel=1e-4)


SPOTS = [
    "write joe at host [dot] com today", "joe at host(dot)org", "joe@host", "joe (at) host dot com", "joe[at]host.com", "mail ann at site dot info now",
    "dead:beef:cafe:babe", "fe80:1:2:3:4", "call 555-123-4567", "4111 1111 1111 1111", "no data here", "look at home", "a at b dot c",
]


@pytest.mark.parametrize("text", SPOTS)
def test_candidates_do_not_depend_on_unrelated_characters(text):
    def found(t):
        column = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": pa.array([t])})
        return next(iter(personal_data._find(iter([column])))).column("spans")[0].as_py()

    assert found(text) == [s for s in found(text + " \n 7") if s["end"] <= len(text)]


def test_written_out_addresses_are_candidates():
    for text in ("write joe at host [dot] com today", "joe at host(dot)org", "dead:beef:cafe:babe"):
        assert personal_data._POSSIBLE.search(text) and personal_data.candidates(text, personal_data.base_spans(text))
