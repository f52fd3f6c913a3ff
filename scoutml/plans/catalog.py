"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

import importlib

_MODULES = ["q_prepare", "q_route", "q_models", "q_cluster", "q_history"]


def _load():
    queries, oracle = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(f"scoutml.plans.{name}")
        queries.update(mod.QUERIES)
        oracle.update(mod.ORACLE)
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
