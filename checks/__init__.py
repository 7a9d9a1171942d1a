"""Registered queries over the test tables, with their reference SQL."""

from checks import feed_queries, model_queries  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
