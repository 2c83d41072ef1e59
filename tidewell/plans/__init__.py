"""The registered queries and the SQL they are held against."""

from __future__ import annotations

from . import documents, evaluation, learning, market  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
