"""All registered queries of the evaluation engine and their SQL."""

from __future__ import annotations

from evalloom.plans import q_costs, q_requests, q_results, q_scores, q_sources, q_stats, q_streams  # noqa: F401
from evalloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
