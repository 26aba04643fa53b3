"""Importing this package registers every query of the core in queries.QUERIES and queries.ORACLES."""

from provrank.plans import build_queries, queries, search_queries  # noqa: F401
