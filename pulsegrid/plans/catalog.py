"""All named queries of the engine."""

from __future__ import annotations

from . import comparison_queries, model_queries, naming_queries, pairing_queries, scope_queries, sequence_queries, session_queries, signal_queries, summary_queries
from .query import Query

QUERIES: dict[str, Query] = {
    **sequence_queries.QUERIES,
    **pairing_queries.QUERIES,
    **summary_queries.QUERIES,
    **model_queries.QUERIES,
    **signal_queries.QUERIES,
    **session_queries.QUERIES,
    **naming_queries.QUERIES,
    **scope_queries.QUERIES,
    **comparison_queries.QUERIES,
}
