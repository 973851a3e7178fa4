"""Registered queries over the driver's tables: each pairs a Spark plan with
its DuckDB oracle SQL (or ``None`` where only a row check is possible)."""

from stratakit.plans.registry import REGISTRY, load_all  # noqa: F401
