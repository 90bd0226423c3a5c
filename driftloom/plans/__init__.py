"""Test-table bindings, queries and their SQL."""

from . import history_queries, lead_queries, pivot_queries, text_queries  # noqa: F401  their queries register themselves
from .drift_queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
