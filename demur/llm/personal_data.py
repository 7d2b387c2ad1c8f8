"""Personal data by weak supervision.

Base patterns find the plain forms. Wider patterns find candidates: other ways to write the
same kinds, and things that only look like them. Labelers (patterns and checksums, short
gazetteers, the words around a span, its shape) vote for or against each candidate or
abstain. Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is, without any labels. The resulting probabilities train a logistic span
classifier on features that need not be any labeler's; it decides about the candidates.
Base spans stay whatever it says.

Vote patterns and features are small codes, so both trainings see all candidates of all
documents as counted groups: at most one row per kind, vote pattern and feature code.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.llm.common import fitted, id_and_text, small_batches, stored

KINDS = ("email", "ip", "card", "phone")
#: a candidate is added from this probability on
ADDED_FROM = 0.9
EM_ROUNDS, TRAINING_STEPS = 40, 400
CONTEXT = 40

# fixed values: the base patterns' parts
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts where a run of digits starts and takes it whole, so nothing is tried twice
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# candidates, all of bounded length
_WIDE = (
    ("email", re.compile(
        r"(?<![\w.%+-])[\w.%+-]{1,64} ?(?:(?:\[at\]|\(at\)| @ |@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z]{2,24}){1,4}"
        r"| at [A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,24}){1,4})(?![\w-])"
    )),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9.])[0-9]{1,5}(?:\.[0-9]{1,5}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./_-]?[0-9]{4}){2,3}[0-9]{0,3}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ ./-])[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9])")),
)
_AT = re.compile(r"\[at\]|\(at\)| @ |@| at [A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)| dot )", re.IGNORECASE)

_FOR = {
    "email": frozenset("email mail e-mail courriel correo contact contacto write schreiben".split()),
    "ip": frozenset("ip host server address adresse addr from login".split()),
    "card": frozenset("card visa mastercard karte carte tarjeta credit payment".split()),
    "phone": frozenset("phone tel telephone telefon téléphone teléfono call mobile fax cell".split()),
}
_AGAINST = frozenset("version v section release isbn order invoice id no number nr page".split())
_ENDINGS = frozenset("com org net edu gov de fr es uk eu info io".split())
_ISSUERS = "3456"
_WORD = re.compile(r"[\w-]+")

FOR, AGAINST, ABSTAIN = 2, 1, 0
LABELERS = ("pattern", "checksum", "gazetteer", "context", "shape")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        # the name is the run of allowed characters before the sign; an earlier start cannot match
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans that the plain patterns find and the checks let pass; ends are exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = _emails(text)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and 18 separators
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out["phone"].append(m.span())
    return out


def _votes(kind: str, text: str, start: int, end: int, plain: bool) -> int:
    """Votes of all labelers as digits to base three, the first labeler lowest."""
    span = text[start:end]
    digits = _digits(span)
    before = [w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT): start])[-3:]]
    pattern = FOR if plain else ABSTAIN
    checksum = gazetteer = shape = ABSTAIN
    if kind == "card":
        checksum = FOR if 13 <= len(digits) <= 19 and luhn(digits) else AGAINST
        gazetteer = FOR if digits[:1] in _ISSUERS else AGAINST
        shape = FOR if re.fullmatch(r"[0-9]{16}|[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}", span) else ABSTAIN
    elif kind == "ip":
        parts = span.split(".")
        if len(parts) == 4:
            checksum = FOR if all(int(p) <= 255 for p in parts) else AGAINST
            gazetteer = AGAINST if parts[0] == "0" else ABSTAIN
            shape = AGAINST if all(len(p) == 1 for p in parts) else FOR
        else:
            checksum = FOR if span.count(":") == 7 else ABSTAIN
            shape = FOR if any(c in "abcdefABCDEF" for c in span) else AGAINST
    elif kind == "phone":
        checksum = FOR if 9 <= len(digits) <= 15 else AGAINST
        gazetteer = FOR if digits.startswith(("0", "1", "33", "34", "49")) or span.startswith("(") else ABSTAIN
        shape = FOR if re.fullmatch(r"(?:\+[0-9]+ )?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}", span) else ABSTAIN
    else:
        ending = re.split(r"[\W_]+", span.lower())[-1]
        gazetteer = FOR if ending in _ENDINGS else AGAINST
        shape = FOR if any(c in "0123456789._" for c in re.split(r"@|\[|\(| ", span)[0]) else ABSTAIN
        checksum = FOR if re.search(r"\[dot\]|\(dot\)| dot |[a-z]\.[a-z]", span) else ABSTAIN
    context = FOR if any(w in _FOR[kind] for w in before) else AGAINST if before[-1:] and before[-1] in _AGAINST else ABSTAIN
    out = 0
    for k, vote in enumerate((pattern, checksum, gazetteer, context, shape)):
        out += vote * 3**k
    return out


#: sizes of the features that make up a feature code
_FEATURES = (5, 4, 3, 3, 2)


def _feature_code(kind: str, text: str, start: int, end: int) -> int:
    """Length, kinds of separators, and characters beside the span; not what labelers look at."""
    span = text[start:end]
    digits = sum("0" <= c <= "9" for c in span)
    separators = len({c for c in span if not c.isalnum()})
    left = text[start - 1: start]
    right = text[end: end + 1]
    side = [0 if not c or c.isspace() else 1 if c in ".,;:!?()[]<>\"'" else 2 for c in (left, right)]
    values = (min(4, (end - start) // 8), min(3, digits // 5), side[0], side[1], int(separators > 1))
    code = 0
    for value, size in zip(values, _FEATURES, strict=True):
        code = code * size + value
    return code


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, int, int, int, bool]]:
    """(kind, start, end, votes, features, whether a base span) of all base and wider spans."""
    out = []
    taken = sorted(s for spans in base.values() for s in spans)
    for k, kind in enumerate(KINDS):
        for start, end in base[kind]:
            out.append((k, start, end, _votes(kind, text, start, end, True), _feature_code(kind, text, start, end), True))
        pattern = dict(_WIDE)[kind]
        if kind == "email":
            spots = [pattern.finditer(text, max(0, m.start() - 66), m.end() + 200) for m in _AT.finditer(text)]
            found = sorted({m.span() for spot in spots for m in spot})
        else:
            found = [m.span() for m in pattern.finditer(text)]
        free = 0
        for start, end in found:
            if start >= free and not any(s < end and start < e for s, e in taken):
                out.append((k, start, end, _votes(kind, text, start, end, False), _feature_code(kind, text, start, end), False))
                free = end
    return out


# what every base and wider pattern has in some form: a digit, a sign between a name and a host,
# or two hexadecimal letters around a colon
_POSSIBLE = re.compile(r"[0-9]|[A-F]:[A-F]|" + _AT.pattern, re.IGNORECASE)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int8()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.int16()), ("features", pa.int16()), ("base", pa.bool_())]))
    for batch in small_batches(batches):
        rows = []
        for text in batch.column("text").to_numpy(zero_copy_only=False).tolist():
            found = candidates(text, base_spans(text)) if _POSSIBLE.search(text) else []
            rows.append([dict(zip(("kind", "start", "end", "votes", "features", "base"), c, strict=True)) for c in found])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])


FOUND = "doc_id long, spans array<struct<kind: tinyint, start: int, end: int, votes: smallint, features: smallint, base: boolean>>"


def vote_table(codes: np.ndarray) -> np.ndarray:
    """Votes of each labeler (columns) for vote codes."""
    return (codes[:, None] // 3 ** np.arange(len(LABELERS))) % 3


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for two classes: probability that each vote pattern is
    personal data, and per class and labeler the chance of each vote.

    Starts from the share of votes for; a smoothing of one vote keeps every chance positive.
    """
    yes, no = (votes == FOR).sum(axis=1), (votes == AGAINST).sum(axis=1)
    p = (yes + 0.5) / (yes + no + 1.0)
    chance = np.full((2, votes.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        share = (p * counts).sum() / max(counts.sum(), 1)
        prior = np.clip(share, 0.05, 0.95)
        log = np.stack([np.full(len(p), np.log(1 - prior)), np.full(len(p), np.log(prior))])
        for c, w in ((0, (1 - p) * counts), (1, p * counts)):
            for k in range(votes.shape[1]):
                used = np.bincount(votes[:, k], weights=w, minlength=3) + (0.5, 1.0 if c == 0 else 0.2, 1.0 if c == 1 else 0.2)
                chance[c, k] = used / used.sum()
                # abstaining says nothing about the class
                log[c] += np.where(votes[:, k] == ABSTAIN, 0.0, np.log(chance[c, k][votes[:, k]]))
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return p, chance


def _design(kinds: np.ndarray, features: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """One column per kind and value of a feature, and per labeler's vote."""
    columns = [np.eye(len(KINDS))[kinds]]
    rest = features.astype(np.int64)
    for size in reversed(_FEATURES):
        columns.append(np.eye(size)[rest % size])
        rest = rest // size
    table = vote_table(votes.astype(np.int64))
    for k in range(1, table.shape[1]):  # whether it is a base span is not a feature
        columns.append(np.eye(3)[table[:, k]])
    return np.hstack(columns)


def fit_classifier(rows: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Weights of the span classifier from counted groups (kind, votes, features, count)."""
    data = np.array(rows, dtype=np.int64).reshape(-1, 4)
    target = np.zeros(len(data))
    for k in range(len(KINDS)):
        own = np.flatnonzero(data[:, 0] == k)
        if len(own):
            target[own], _ = reliabilities(vote_table(data[own, 1]), data[own, 3].astype(float))
    x = _design(data[:, 0], data[:, 2], data[:, 1])
    weight = np.log1p(data[:, 3])  # a form seen often does not outweigh all others
    weight = weight / max(weight.sum(), 1e-9)
    w = np.zeros(x.shape[1])
    for _ in range(TRAINING_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (weight * (p - target)) + 1e-4 * w)
    return w


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and spans of personal data in every row.

    ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``base_sha256`` of
    the base spans, ``spans`` (base and added ones). A span is kind:start:end in code points,
    ordered by kind as listed and start, joined by commas. A null text counts as empty and
    gives no spans. Other columns are not looked at.
    """
    found = stored(id_and_text(docs).mapInArrow(_find, FOUND), "spans")
    groups = found.select(F.explode("spans").alias("s")).select("s.*").groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))
    # at most kinds x 3^5 vote patterns x 360 feature codes
    weights = fitted(groups, lambda rows: fit_classifier(sorted((r["kind"], r["votes"], r["features"], r["n"]) for r in rows)))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_decided(spans or [], weights) for spans in batch.column("spans").to_pylist()]
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return found.mapInArrow(decide, schema)


def _decided(spans: list[dict], weights: np.ndarray) -> tuple:
    base = [s for s in spans if s["base"]]
    other = [s for s in spans if not s["base"]]
    if other:
        x = _design(*[np.array([s[c] for s in other]) for c in ("kind", "features", "votes")])
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        other = [s for s, q in zip(other, p, strict=True) if q >= ADDED_FROM]
    counts = [sum(s["kind"] == k for s in base) for k in range(len(KINDS))]
    return (*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + other))


def _joined(spans: list[dict]) -> str:
    ordered = sorted((s["kind"], s["start"], s["end"]) for s in spans)
    return ",".join(f"{KINDS[k]}:{start}:{end}" for k, start, end in ordered)
