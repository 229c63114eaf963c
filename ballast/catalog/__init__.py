"""Registered queries: each operator bound to the given tables, with its SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from ballast.catalog.registry import ORACLES, QUERIES

for _part in ("analysis", "columns", "profile", "features", "sampling", "storage", "learning"):
    import_module(f"ballast.catalog.{_part}")

__all__ = ["QUERIES", "ORACLES"]
