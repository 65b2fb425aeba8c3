"""Registered queries and the SQL that each must equal."""

from corpuslens.plans import corpus_queries, io_queries, relational_queries, retrieval_queries, set_queries, text_queries  # noqa: F401
from corpuslens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
