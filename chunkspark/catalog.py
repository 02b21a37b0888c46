"""Queries of the engine by name, and the same in SQL."""

from __future__ import annotations

from chunkspark.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
