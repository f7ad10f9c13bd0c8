"""Queries and oracle SQL of the screening operators."""

from __future__ import annotations

from . import pixel_queries, screening_queries, shape_queries, token_queries, train_queries, verdict_queries

_MODULES = (verdict_queries, token_queries, shape_queries, pixel_queries, train_queries, screening_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
