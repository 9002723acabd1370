"""All registered queries of the library."""

from . import graph_queries, pattern_queries, search_queries, store_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
