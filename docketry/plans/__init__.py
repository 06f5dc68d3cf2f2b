"""Views over the test tables and the registry of runnable queries with their SQL counterparts."""

from __future__ import annotations

import importlib

from docketry.plans.registry import ORACLES, QUERIES

MODULES = ("files", "text", "represent", "rank", "training", "evaluate")


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"docketry.plans.{module}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
