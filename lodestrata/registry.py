"""Queries and oracle SQL of the library's own operators, gathered from the modules of ``plans``."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from . import plans

FLAGSHIP = "relation_stats"


def _modules() -> list:
    """Every module of ``plans`` that registers queries, by name."""
    names = sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name != "base")
    return [importlib.import_module(f"{plans.__name__}.{n}") for n in names]


def queries() -> dict[str, Callable]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
