import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.series import densify, trailing
from tallyloom.operators import decompose as y
from tallyloom.operators import features as e
from tallyloom.plans.common import panel_sales

START = dt.date(2000, 1, 1)


def frame(spark, values, series="s", start=START):
    rows = [(series, start + dt.timedelta(days=i), float(v), float(v) * 0.6) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, date date, revenue double, cogs double")


def test_densify_fills_gaps_and_stretches_all_series(spark):
    rows = [("a", START, 1.0), ("a", START + dt.timedelta(days=3), 4.0), ("b", START + dt.timedelta(days=1), 2.0)]
    df = spark.createDataFrame(rows, "k string, date date, v double")
    got = {(r.k, (r.date - START).days): r.v for r in densify(df, ["k"], ["v"]).collect()}
    assert got == {("a", 0): 1, ("a", 1): 0, ("a", 2): 0, ("a", 3): 4, ("b", 0): 0, ("b", 1): 2, ("b", 2): 0, ("b", 3): 0}
    single = densify(df.filter("k = 'a'").drop("k"), [], ["v"]).orderBy("date").collect()
    assert [r.v for r in single] == [1, 0, 0, 4]


def test_trailing_mean_is_by_row(spark):
    df = frame(spark, [1, 2, 3, 4])
    got = df.select("date", trailing(F.avg("revenue"), 3, ["series"]).alias("m")).orderBy("date").collect()
    assert [r.m for r in got] == [1.0, 1.5, 2.0, 3.0]


def test_windowed_features_equal_the_row_definition(spark):
    values = [100 + 10 * (i % 7) + i * 0.3 + (i * 37 % 11) for i in range(420)]
    row = (
        e.extended_features(frame(spark, values), "revenue", ["series"])
        .filter(F.col("trend_idx") == 400)
        .collect()[0]
    )
    past = pd.Series(values[:400])
    for k in e.LAGS:
        assert row[f"lag_{k}"] == past.iloc[-k]
    for w in e.WINDOWS:
        last = past.iloc[-w:]
        assert row[f"roll_mean_{w}"] == pytest.approx(last.mean())
        assert row[f"roll_std_{w}"] == pytest.approx(last.std())
        assert (row[f"roll_min_{w}"], row[f"roll_max_{w}"]) == (last.min(), last.max())
    day = START + dt.timedelta(days=400)
    dates = [START + dt.timedelta(days=i) for i in range(400)]
    same = [v for d, v in zip(dates, values) if d.weekday() == day.weekday()]
    assert row["dow_profile"] == pytest.approx(pd.Series(same).median())
    same = [v for d, v in zip(dates, values) if d.timetuple().tm_yday == day.timetuple().tm_yday]
    assert row["doy_profile"] == pytest.approx(pd.Series(same).median() if same else past.iloc[-28:].mean())


def test_features_do_not_see_the_future(spark):
    """Changing the last value moves no feature of its own row or of any row before it."""
    values = [50 + (i * 13 % 29) for i in range(400)]
    one = e.dual_features(frame(spark, values), ["series"])
    two = e.dual_features(frame(spark, [*values[:-1], 9999]), ["series"])
    cols = ["date", *e.DUAL_FEATURES]
    assert sorted(map(repr, one.select(cols).collect())) == sorted(map(repr, two.select(cols).collect()))
    one = e.extended_features(frame(spark, values), "revenue", ["series"]).select("date", *e.EXTENDED_FEATURES)
    two = e.extended_features(frame(spark, [*values[:-1], 9999]), "revenue", ["series"]).select("date", *e.EXTENDED_FEATURES)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_feature_counts():
    assert (len(e.BASELINE_FEATURES), len(e.EXTENDED_FEATURES), len(e.DUAL_FEATURES)) == (15, 46, 76)
    assert sorted(f for g in e.FEATURE_GROUPS.values() for f in g) == sorted(e.EXTENDED_FEATURES)


def test_decomposition_adds_up_and_flat_series_has_no_shares(spark):
    values = [1000 + i + 50 * (i % 7) for i in range(800)]
    parts = y.decompose(frame(spark, values), "revenue", ["series"])
    worst = parts.select(
        F.max(F.abs(F.col("revenue") - F.col("trend") - F.col("seasonality") - F.col("promotional"))).alias("w")
    ).collect()[0]["w"]
    assert worst < 1e-6
    flat = y.variance_shares(y.decompose(frame(spark, [5.0] * 400), "revenue", ["series"]), "revenue", ["series"])
    assert {r.pct_total for r in flat.collect()} == {0.0}


def test_growth_profile_forecast_doubles_a_doubling_series(spark):
    rows = []
    for year in range(2001, 2005):
        for i in range(366 if year % 4 == 0 else 365):
            d = dt.date(year, 1, 1) + dt.timedelta(days=i)
            rows.append((d, 100.0 * 2 ** (year - 2001) * (2.0 if d.month == 12 else 1.0)))
    df = spark.createDataFrame(rows, "date date, revenue double")
    out = {r.date: r.revenue_pred for r in y.growth_profile_forecast(df, 365, ["revenue"]).collect()}
    december, june = out[dt.date(2005, 12, 15)], out[dt.date(2005, 6, 15)]
    assert december / june == pytest.approx(2.0, rel=1e-6)
    assert june == pytest.approx(1600.0, rel=0.02)


def test_leap_day_without_profile_counts_as_one(spark):
    rows = [(dt.date(y_, 1, 1) + dt.timedelta(days=i), 10.0) for y_ in (2001, 2002, 2003) for i in range(365)]
    out = y.growth_profile_forecast(spark.createDataFrame(rows, "date date, revenue double"), 366, ["revenue"])
    leap = out.filter(F.col("date") == dt.date(2004, 2, 29)).collect()[0]
    assert leap.revenue_pred == pytest.approx(10.0)


def test_panel_has_every_day_for_every_series(tables):
    counts = {r["count"] for r in panel_sales(tables).groupBy("series").count().collect()}
    assert len(counts) == 1
