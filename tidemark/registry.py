"""All registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its own name, with its oracle where SQL can express it."""

    def register(function: Callable) -> Callable:
        key = name or function.__name__
        assert key not in QUERIES, key
        QUERIES[key] = function
        if sql is not None:
            ORACLE[key] = sql
        return function

    return register


from tidemark.plans import MODULES  # noqa: E402

for _module in MODULES:
    import_module(f"tidemark.plans.{_module}")
