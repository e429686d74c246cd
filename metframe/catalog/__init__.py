"""Every query of the package by name, with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from metframe.catalog import entities, fields, filters, places, tables, texts
from metframe.catalog.base import Query

_MODULES = [filters, texts, fields, entities, places, tables]


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in _MODULES:
        for query in module.QUERIES:
            if query.name in found:
                raise ValueError(f"two queries named {query.name}")
            found[query.name] = query
    return found
