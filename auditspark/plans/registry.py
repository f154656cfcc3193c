"""All registered queries of the library: a Spark callable, and DuckDB SQL where it can be expressed."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES (name -> callable) and ORACLES (name -> SQL).
MODULES: list[str] = ["archive", "messages", "statistics", "nested", "governance", "corpus", "logs"]


def _all(kind: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"auditspark.plans.{module}"), kind)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
