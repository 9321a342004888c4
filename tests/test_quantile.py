import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyloom.functions.quantile import exact_quantiles

PROBS = {"q10": 0.1, "q50": 0.5, "q75": 0.75, "q100": 1.0}


def expected(values):
    return {k: float(np.quantile(values, p)) for k, p in PROBS.items()}


def check(spark, groups, **kwargs):
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v double")
    kwargs.setdefault("cell_rows", 3)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", PROBS, **kwargs).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        for name, want in expected(values).items():
            assert got[k][name] == pytest.approx(want, rel=1e-12, abs=1e-9)


def test_groups_of_every_shape(spark):
    rng = np.random.default_rng(1)
    check(
        spark,
        {
            "hot": rng.normal(0, 1e6, 5000),
            "one": [3.5],
            "constant": [2.0] * 50,
            "two": [1.0, 10.0],
            "heavy_tail": np.concatenate([rng.random(500), [1e15, -1e15]]),
            "repeated": np.repeat([1.0, 2.0, 3.0], [1000, 1, 1000]),
        },
    )


def test_few_bins_and_many_levels(spark):
    rng = np.random.default_rng(2)
    check(spark, {"a": rng.random(300), "b": rng.integers(0, 5, 300)}, bins=2)


def test_small_inputs_need_no_round(spark):
    check(spark, {"a": [1.0, 5.0, 5.0, 9.0], "b": [2.0]}, cell_rows=100)


def test_tiers_of_outliers_leave_no_large_cell(spark, monkeypatch):
    """A body of 0 to 1000 below values of 1e8 and 1e12: the last cells stay small."""
    from tallyloom.functions import quantile

    seen = []
    real = quantile.largest_cell
    monkeypatch.setattr(quantile, "largest_cell", lambda x, g: seen.append(real(x, g)) or seen[-1])
    rng = np.random.default_rng(4)
    check(spark, {"a": [*(rng.random(20_000) * 1000), 1e8, 1e12]}, cell_rows=500)
    assert len(seen) > 2 and seen[-1] <= 500


def test_nulls_are_left_out_and_no_key_is_one_group(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None), ("a", 4.0), ("a", 2.0)], "k string, v double")
    assert [tuple(r) for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()] == [("a", 3.0)]
    assert exact_quantiles(df, [], "v", {"m": 0.5}).collect()[0]["m"] == 2.0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=1, max_size=60))
def test_any_list(spark, values):
    check(spark, {"x": values}, bins=4)


def test_values_of_one_group_meet_their_cells_where_they_lie(spark, monkeypatch):
    """Also where tables are too large to be broadcast by themselves: no sort of a whole group in one task."""
    from tallyloom.functions import quantile

    plans = []
    real = quantile.store

    def seen(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, label)

    monkeypatch.setattr(quantile, "store", seen)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(3000).selectExpr("cast(id as double) as v")
        assert exact_quantiles(df, [], "v", {"m": 0.5}, cell_rows=50).collect()[0]["m"] == 1499.5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    rounds = [plan for label, plan in plans if label == "cells"]
    assert rounds and not any("SortMergeJoin" in plan for plan in rounds)
