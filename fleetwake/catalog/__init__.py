"""Queries over the given tables, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every query module and return (queries, SQL)."""
    from fleetwake.catalog import base

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return base.QUERIES, base.ORACLES
