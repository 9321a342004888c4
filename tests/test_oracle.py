"""Every named query that has SQL, value by value against DuckDB on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from check_oracle import compare, connect  # noqa: E402
from tallyloom.plans import load_catalog  # noqa: E402
from tallyloom.plans.catalog import run  # noqa: E402

from .conftest import DATA  # noqa: E402

CATALOG = load_catalog()

# Check rows of all fitted forecasts: minutes of fitting. `python check_oracle.py --only F07_f,F13_o` runs them.
FITTED = ("F07_forecast_checks", "F13_output_contract")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql and n not in FITTED])
def test_matches_sql(spark, con, name):
    assert compare(run(name, spark, DATA), con, CATALOG[name].sql) == []
