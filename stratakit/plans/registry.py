"""Query registry: ``@query(name, sql)`` records a ``(spark, sf_dir) ->
DataFrame`` builder and the equivalent DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}

MODULES = ["population", "recommend", "features", "strata", "fairness", "queues"]

SEED = 42


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Callable, str | None]]:
    for m in MODULES:
        importlib.import_module(f"stratakit.plans.{m}")
    return REGISTRY
