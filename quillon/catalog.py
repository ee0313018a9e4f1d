"""Registry of queries over the driver's tables with their oracle SQL."""

from __future__ import annotations

from quillon.plans import aggregate_queries, feature_queries, panel_queries, profile_queries, resolve_queries, source_queries  # noqa: F401
from quillon.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
