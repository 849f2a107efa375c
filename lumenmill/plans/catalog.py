"""All queries of the engine's own operators."""

from __future__ import annotations

from . import operator_queries, sqltext, surface_queries

_PARTS = (sqltext, operator_queries, surface_queries)


def queries() -> dict:
    """Name to query function."""
    return {k: v for part in _PARTS for k, v in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {k: v for part in _PARTS for k, v in part.oracle_sql().items()}
