"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import importlib

from larder.plans import registry

GROUPS = ["member_queries", "nutrition_queries", "recipe_queries", "recommend_queries", "document_queries", "place_queries", "stream_queries",
          "file_queries"]


def _load() -> None:
    for group in GROUPS:
        importlib.import_module(f"larder.plans.{group}")


def all_queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
