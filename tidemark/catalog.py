"""All registered queries and their oracle SQL."""

from __future__ import annotations

from tidemark.plans import briefing, features, files, policies, screening, series, tables  # noqa: F401  they register their queries
from tidemark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
