"""Queries over the test tables, one or more per operator."""

from catalog import cleaning, comparing, filtering, grouping, joining, loading, splitting
from catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cleaning", "comparing", "filtering", "grouping", "joining", "loading", "splitting"]
