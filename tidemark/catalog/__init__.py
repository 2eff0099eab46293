"""Every registered query, by name."""

from __future__ import annotations

from importlib import import_module

from tidemark.catalog.common import Query

MODULES = ["scoring", "vectors", "wide", "reports", "structure", "source_flow", "streams"]


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        for key, query in import_module(f"tidemark.catalog.{name}").QUERIES.items():
            if key in found:
                raise ValueError(f"query {key} is registered twice")
            found[key] = query
    return found
