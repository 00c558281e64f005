"""Registered queries, each with its SQL where SQL can say the same."""

from tidepool.plans import basics, discovery, features, learning, profiling  # noqa: F401
from tidepool.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
