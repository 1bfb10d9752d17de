"""Registered queries: each runs an operator over whole given tables; most carry SQL of equal meaning."""

from __future__ import annotations

import importlib

from catalog.registry import ORACLE, QUERIES

for _part in ("scalar", "history", "joining", "aggregate", "signal", "gold", "evaluation", "quality", "analysis", "training", "models", "similar"):
    importlib.import_module(f"catalog.{_part}")

__all__ = ["QUERIES", "ORACLE"]
