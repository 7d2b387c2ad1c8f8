"""Quality votes against a plain projection, cosine and vote."""

import numpy as np
import pyarrow as pa
import pytest

from demur.llm import quality


def sample(n, seed):
    rng = np.random.default_rng(seed)
    good = [" ".join(rng.choice(["river", "stone", "walks", "quietly", "the", "and", "morning."], size=rng.integers(1, 60))) for _ in range(n)]
    bad = ["".join(rng.choice(list("#$%@~^&*|<> 0987"), size=rng.integers(1, 300))) for _ in range(n)]
    return good + bad, np.array([1.0] * n + [0.0] * n)


def plain_scores(voters, counts):
    out = []
    for row in counts:
        vector = quality._weighted(row[None], voters.weights)[0] @ voters.basis
        norm = np.sqrt(sum(float(x) ** 2 for x in vector))
        cosine = [float(np.dot(vector, v)) / norm if norm else 0.0 for v in voters.vectors]
        near = sorted(range(len(cosine)), key=lambda k: -cosine[k])[: quality.VOTERS]
        # 60 of each label are voters for labelled rows of which 0.6 have label 1
        weight = {k: max(0.0, min(1.0, cosine[k])) ** quality.POWER * (1.2 if voters.labels[k] else 0.8) for k in near}
        total, size = sum(weight.values()), row[: quality._TRIGRAMS].sum()
        trust = size / (size + voters.prior_bytes) if total > 1e-9 and size else 0.0
        voted = sum(w * voters.labels[k] for k, w in weight.items()) / total if total > 1e-9 else 0.0
        out.append(trust * voted + (1 - trust) * voters.prior)
    return out


def test_scores_by_plain_vote():
    texts, labels = sample(60, 1)
    counts = quality.features(pa.array(texts))
    voters = quality.fit_space(counts, labels, 0.6, dimensions=12)
    others = quality.features(pa.array([*sample(25, 2)[0], "", None, "ab", "a b", "#%"]))
    assert voters.scores(others) == pytest.approx(plain_scores(voters, others), abs=2e-3)
    assert voters.shares()[[0, -1]].tolist() == pytest.approx([1.2, 0.8])
    assert voters.scores(quality.features(pa.array(["", None, "a"]))) == pytest.approx([0.6] * 3)


def test_prior_is_what_predicts_voters_best():
    texts, labels = sample(80, 3)
    counts = quality.features(pa.array(texts))
    voters = quality.fit_space(counts, labels, 0.5)
    assert voters.prior_bytes in quality.PRIOR_BYTES and voters.prior_bytes <= 30  # short texts are told apart well here
    mixed = quality.fit_space(counts, np.random.default_rng(0).permutation(labels), 0.5)
    assert mixed.prior_bytes >= voters.prior_bytes


def test_a_text_has_one_vector_as_voter_and_as_document():
    counts = quality.features(pa.array(["x" * 200_000, "some plain words here"]))
    assert counts[0].max() > 65_504 and np.isfinite(counts.astype("<f4")).all()
