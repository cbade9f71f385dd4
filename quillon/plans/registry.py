"""All registered queries with their DuckDB SQL."""

from __future__ import annotations

from . import catalog, details, evaluation, maintenance, preferences, relational, retrieval, text
from .query import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalog", "details", "evaluation", "maintenance", "preferences", "relational", "retrieval", "text"]
