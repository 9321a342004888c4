"""Operators of a training-data pipeline, and the named queries that apply them to whole tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("exact_dedup", "quality", "mixing", "packing", "sharding", "chat", "secret_scan", "cover_tree", "language", "simhash", "periodic", "importance", "site_tree")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [import_module(f"{__name__}.{m}") for m in MODULES]
    return {name: f for module in found for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = [import_module(f"{__name__}.{m}") for m in MODULES]
    return {name: sql for module in found for name, sql in getattr(module, "SQL", {}).items()}
