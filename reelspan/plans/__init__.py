"""Named queries over the tables of a data folder, and the SQL each must equal."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules


def _modules():
    return [import_module(f"{__name__}.{m.name}") for m in iter_modules(__path__) if m.name.endswith("_queries")]


def all_queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def all_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
