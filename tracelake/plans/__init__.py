"""Registered queries, grouped by what they answer."""

from __future__ import annotations

import importlib

MODULES = ("bindings", "columns", "items", "lineage", "store", "audit", "transfer", "changes", "documents", "trees", "streams")


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"tracelake.plans.{module}")
