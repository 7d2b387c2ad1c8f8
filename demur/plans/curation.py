"""From raw multi-document questions to a curated set of equal size per domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from demur import vocab
from demur.operators import passages, sampling
from demur.sources import sinks


def curated_dataset(
    records: DataFrame, domains: Sequence[str] = vocab.TARGET_DOMAINS, per_domain: int = vocab.PER_DOMAIN, total: int = vocab.TOTAL_PASSAGES,
    signal: int = vocab.SIGNAL_PASSAGES, seed: int = vocab.SEED, source_dataset: str | None = None,
) -> DataFrame:
    """Eligible questions, sampled per domain, cut to ``total`` passages.

    Questions that cannot be filled are left out before the sample is drawn, so that every
    domain gets its number as long as it has enough.
    """
    composed = passages.compose(passages.eligible(records, total), total, signal, source_dataset)
    return sampling.domain_sample(composed, domains, per_domain, seed)


def write_curated(records: DataFrame, path: str, **options) -> None:
    """The curated records and the number of candidates per domain, as JSON lines."""
    sinks.write_jsonl(curated_dataset(records, **options), f"{path}/dataset")
    total = options.get("total", vocab.TOTAL_PASSAGES)
    candidates = passages.domain_candidates(passages.eligible(records, total), options.get("domains", vocab.TARGET_DOMAINS))
    sinks.write_jsonl(candidates, f"{path}/candidates")
