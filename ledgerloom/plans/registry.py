"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from .views import CTE

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Register a function (spark, sf_dir) -> DataFrame under its own name; ``base`` puts the bank view before the SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql and base:
            words, own = sql.strip(), sql.strip().lower().startswith("with ")
            loop = own and words[5:].lstrip().lower().startswith("recursive ")
            rest = words[5:].lstrip()[10:] if loop else words[5:]
            SQL[f.__name__] = (CTE.replace("with ", "with recursive ", 1) if loop else CTE) + (", " + rest if own else sql)
        elif sql:
            SQL[f.__name__] = sql
        return f

    return add
