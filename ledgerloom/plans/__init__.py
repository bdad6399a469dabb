"""Registered queries: each applies library operators to the bank view of the given tables, with SQL for the same rows."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """All registered queries and their SQL."""
    from . import aggregates, balances, candidates, evidence, feeds, histories, imports, layouts, learning, matches, reading, report_rows, scalars, selections, statements  # noqa: F401
    from .registry import QUERIES, SQL

    return QUERIES, SQL
