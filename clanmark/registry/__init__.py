"""Registered queries: each operator over whole tables, with its SQL counterpart."""

from __future__ import annotations

import importlib
from types import ModuleType

PARTS = ("vector", "source", "filter", "similarity", "cluster", "summary", "assign", "maintain", "layout")


def load() -> ModuleType:
    """Import every query module and return the table of queries."""
    for part in PARTS:
        importlib.import_module(f"clanmark.registry.{part}_queries")
    return importlib.import_module("clanmark.registry.base")
