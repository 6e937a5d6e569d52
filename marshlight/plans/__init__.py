"""Registered queries, grouped by the kind of operator they exercise."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    for mod in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{mod.name}")
    return dict(sorted(QUERIES.items()))
