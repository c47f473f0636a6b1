"""The registered queries."""

from . import builtin_queries, field_queries, join_queries, report_queries, rollup_queries, score_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "builtin_queries", "field_queries", "join_queries", "report_queries", "rollup_queries", "score_queries"]
