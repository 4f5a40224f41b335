"""All queries of the engine's own operators and the SQL that they are checked with."""

from __future__ import annotations

from . import queries_learning, queries_matrix, queries_stores, queries_transforms  # noqa: F401  they register themselves
from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
