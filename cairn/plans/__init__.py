"""Registered queries: QUERIES by name, and their SQL in ORACLES."""

from . import further_queries, record_queries, relational_queries, scalar_queries, source_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
