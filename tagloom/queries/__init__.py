"""Registered queries: every operator over the given tables, and the SQL each result must equal."""

from . import extraction, formulas, lookups, profiles, results
from .oracle import oracle_sql


def queries():
    """Name -> ``fn(spark, folder)`` for all registered queries."""
    found = {}
    for module in (extraction, formulas, results, lookups, profiles):
        found |= module.QUERIES
    return found


__all__ = ["oracle_sql", "queries"]
