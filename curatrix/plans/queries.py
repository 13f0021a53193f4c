"""All queries: importing the modules fills the catalog."""

from curatrix.plans import queries_joins, queries_json, queries_metrics, queries_splits, queries_stream, queries_text, queries_threads  # noqa: F401
from curatrix.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
