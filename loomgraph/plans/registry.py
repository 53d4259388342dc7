"""Every query of the graph library by name, and its SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Modules that register queries when they are imported.
MODULES = ("graph_queries", "view_queries", "choice_queries", "element_queries", "structure_queries", "selection_queries", "arrangement_queries")


def query(oracle: str | None = None) -> Callable:
    """Registers a query (spark, sf_dir) under its own name, with the SQL that gives its rows."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"loomgraph.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
