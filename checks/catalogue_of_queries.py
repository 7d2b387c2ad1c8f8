"""Importing this module fills the registry."""

from checks import io_queries, metric_queries, plan_queries, prompt_queries, record_queries, vote_queries  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
