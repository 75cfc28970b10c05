"""Runnable queries over the derived evaluation tables."""

from __future__ import annotations

import importlib

MODULES = ("scoring", "lanes", "decisions", "traces", "ingest", "models", "live", "reports", "small")


def load():
    """Import every query module and return (queries, checks)."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    from .registry import CHECKS, QUERIES

    return QUERIES, CHECKS
