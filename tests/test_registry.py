"""The inventory is covered, the entry points agree, and no plan holds a cross product."""

import re

import pytest

import __spark_entry__ as entry
from tallyloom.plans import load_catalog
from tallyloom.plans.catalog import run

from .conftest import DATA

FAMILIES = {"S": 10, "P": 20, "J": 12, "G": 20, "W": 11, "K": 4, "U": 3, "C": 9, "Q": 25, "A": 14, "D": 14, "X": 24,
            "Y": 18, "E": 11, "F": 13, "B": 9, "V": 5}
CATALOG = load_catalog()
FITTED = {n for n, q in CATALOG.items() if q.sql is None}


def test_every_inventory_entry_has_a_query():
    covered = {part for name in CATALOG for part in re.findall(r"(?:^|_)([A-Z]\d\d)(?=_)", name + "_")}
    wanted = {f"{family}{i:02d}" for family, n in FAMILIES.items() for i in range(1, n + 1)}
    assert wanted - covered == set()


def test_entry_points_agree(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["acquisition_channel", "total_revenue", "avg_item_value", "order_count", "revenue_pct", "orders_pct"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(set(CATALOG) - FITTED))
def test_no_cross_product_in_plan(spark, name):
    """With broadcasting off, what is left shows the joins as they run at scale."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = run(name, spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan


@pytest.mark.parametrize(
    "name, columns",
    [
        ("A05_promotion_share", {"l_discount"}),
        ("D07_category_revenue", {"l_partkey", "l_quantity", "l_extendedprice"}),
        ("A13_payment_by_installments", {"o_totalprice", "o_orderpriority"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    plan = run(name, spark, DATA)._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    found = {c.split(":")[0] for c in read[0].split(",")}
    assert found == columns


def test_filters_reach_the_scan(spark):
    plan = run("X09_return_reasons", spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan
