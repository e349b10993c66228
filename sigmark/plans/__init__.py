"""Registered queries, each with the SQL that it must equal."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules


def load() -> tuple[dict, dict]:
    """All queries and their SQL: every module here registers its own."""
    for m in iter_modules(__path__):
        import_module(f"{__name__}.{m.name}")
    from .registry import QUERIES, SQL

    return QUERIES, SQL
