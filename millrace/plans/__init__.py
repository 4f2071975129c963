"""Registered queries over the driver's tables, and their SQL."""

from millrace.plans import code_queries, event_queries, fixture_queries, function_queries, review_queries, text_queries, vector_queries
from millrace.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "code_queries", "event_queries", "fixture_queries", "function_queries", "review_queries", "text_queries", "vector_queries"]
