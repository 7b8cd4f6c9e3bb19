"""Collects the queries of every topic module."""

from __future__ import annotations

import importlib

MODULES = ["scalars", "zones", "mapping", "routing", "privacy", "evaluation", "templating", "files",
           "stored", "streams"]

_queries: dict = {}
_sql: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a query (spark, sf_dir) -> DataFrame and its SQL."""
    def add(fn):
        if name in _queries:
            raise ValueError(f"duplicate query {name}")
        _queries[name] = fn
        if sql is not None:
            _sql[name] = sql
        return fn
    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"catalog.{module}")


def queries() -> dict:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def flagship(spark, sf_dir):
    _load()
    return _queries["zone_fields_td1"](spark, sf_dir)
