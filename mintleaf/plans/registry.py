"""Collects the registered queries and their SQL from the query modules of this package."""

from __future__ import annotations

import importlib
import pkgutil

import mintleaf.plans as plans


def _modules():
    for info in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        if info.name.startswith("q_"):
            yield importlib.import_module(f"mintleaf.plans.{info.name}")


def queries() -> dict:
    """Name -> callable(spark, sf_dir) for every query module ``q_*``."""
    found: dict = {}
    for module in _modules():
        found |= module.QUERIES
    return found


def oracle_sql() -> dict:
    """Name -> DuckDB SQL, for the queries that SQL can express."""
    found: dict = {}
    for module in _modules():
        found |= module.ORACLE_SQL
    return found
