"""All registered queries."""

from __future__ import annotations

from trialloom.plans import array_queries, clean_queries, model_queries, profile_queries, ranking_queries, solution_queries  # noqa: F401
from trialloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
