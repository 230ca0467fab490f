"""Bindings of the operators to the given tables, each beside the SQL that must give the same rows."""
from __future__ import annotations

import importlib

_MODULES = [
    "links", "sources", "urls", "text", "names", "extraction", "registry_records", "gate_checks", "linkage", "aggregates", "windows", "sets",
    "summaries", "streams", "runs",
]


def load():
    """The registry with every binding imported."""
    for name in _MODULES:
        importlib.import_module(f"factloom.catalog.{name}")
    return importlib.import_module("factloom.catalog.registry")
