"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("packing", "merge_automaton", "quality", "pii", "licenses", "token_counts", "warc", "media", "substrings", "near_dups")


def _all(name: str) -> dict:
    return {k: v for m in _MODULES for k, v in getattr(import_module(f"wordloom.llm.{m}"), name, {}).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE_SQL")
