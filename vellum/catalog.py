"""Name -> (query, oracle SQL): what the modules of vellum.plans register."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("documents", "rollups", "queue", "storage", "streams", "pages", "evidence", "products", "details", "lifecycles", "extracted", "readmodels", "wholes")


def _collect(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"vellum.plans.{module}"), name)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE_SQL")
