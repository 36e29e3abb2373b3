"""Runnable queries over the standard tables, one per operator."""

from __future__ import annotations

import importlib

MODULES = ("sources", "columns", "rules", "compare", "clean", "encode", "reshape", "profile", "quality", "anomalies", "streams", "models", "ml")


def load():
    """(queries, SQL twins) of all modules."""
    from . import base

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return dict(base.QUERIES), dict(base.ORACLES)
