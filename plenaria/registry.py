"""Queries of the analytics part, by name, and the DuckDB SQL that each must equal."""

from __future__ import annotations

from .plans import branches, stored  # noqa: F401  they add their queries
from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
