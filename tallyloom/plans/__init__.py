"""Named queries, one module per section of the operator inventory."""

from __future__ import annotations

import importlib

from tallyloom.plans.catalog import CATALOG, NamedQuery

MODULES = (
    "relational",
    "audit",
    "questions",
    "kpi",
    "diagnostics",
    "series",
    "long_series",
    "models",
)


def load_catalog() -> dict[str, NamedQuery]:
    """Import every module of named queries and return the filled registry."""
    for name in MODULES:
        importlib.import_module(f"tallyloom.plans.{name}")
    return CATALOG
