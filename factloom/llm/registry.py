"""Queries of this package and the SQL that must give the same rows."""
from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
_MODULES = ["url_filter", "license_scan", "quality_rules", "token_files", "packing", "warc", "minhash", "repeats", "lines", "decontaminate", "spelling", "negatives", "secrets"]


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def load() -> None:
    for name in _MODULES:
        importlib.import_module(f"factloom.llm.{name}")
