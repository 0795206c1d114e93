"""Registry of the engine's queries, each with the SQL of the same rows where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES: tuple[str, ...] = ("vector_plans", "cluster_plans", "stat_plans", "budget_plans", "select_plans", "retrieval_plans", "record_plans", "text_plans")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(importlib.import_module(f"{__name__}.{module}"), name)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict[str, Callable]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
