"""All queries over the reference tables, each beside its SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("corpus", "phrases", "stats", "terms", "rules", "meta")


def _all(name: str) -> dict:
    return {k: v for m in _MODULES for k, v in getattr(import_module(f"wordloom.queries.{m}"), name).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE_SQL")
