"""All registered queries of the library, apart from the training-data subpackage."""

from . import call_queries, line_queries, metric_queries, more_queries, window_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
