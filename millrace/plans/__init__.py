"""Queries on the given tables: one module for each part of the inventory, each with QUERIES and SQL."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    return [importlib.import_module(f"{__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name)]


def queries() -> dict:
    return {k: q for m in _modules() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in m.SQL.items()}
