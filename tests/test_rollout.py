"""Series that step together against one series at a time, one day after another, with plain lists."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.expr import calendar_columns
from tallyloom.operators import features as e
from tallyloom.operators import forecast as f
from tallyloom.operators import rollout

START = dt.date(2015, 3, 1)
LENGTHS = {"a": 700, "b": 366, "c": 365, "d": 400, None: 500, "short": 100, "week": 3}
AHEAD = 40


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    rows = []
    for name, n in LENGTHS.items():
        offset = 0 if name != "d" else 11  # ends on another day
        for i in range(n):
            v = float(100 + 20 * math.sin(i / 58) + rng.normal(0, 5))
            rows.append((name, START + dt.timedelta(days=700 - n + i + offset), v, 0.6 * v + float(rng.normal(0, 2))))
    return spark.createDataFrame(rows, "series string, date date, revenue double, cogs double").cache()


def trees(names, seed, count=9, depth=3):
    """Random full trees over the features, thresholds near the values that occur."""
    rng = np.random.default_rng(seed)
    size = 2 ** (depth + 1) - 1
    inner = np.arange(size) < size // 2
    shape = (count, size)
    left = np.where(inner, np.arange(size) * 2 + 1, np.arange(size))
    return f.Scorer(
        tuple(names), weights=rng.normal(1, 0.2, count) / count, depth=depth,
        feature=np.where(inner, rng.integers(0, len(names), shape), 0), threshold=np.where(inner, rng.normal(90, 30, shape), np.inf),
        left=np.tile(left, (count, 1)), right=np.tile(np.where(inner, left + 1, np.arange(size)), (count, 1)),
        value=rng.normal(100, 15, shape),
    )


def linear(names, seed):
    rng = np.random.default_rng(seed)
    return f.Scorer(tuple(names), intercept=30.0, coefficients=rng.normal(0, 0.6, len(names)) / len(names))


def walk(scorer, row):
    """One row through the model, one tree after the other."""
    if scorer.coefficients is not None:
        return math.fsum(c * row[n] for c, n in zip(scorer.coefficients, scorer.features)) + scorer.intercept
    total = 0.0
    for k, weight in enumerate(scorer.weights):
        node = 0
        while scorer.left[k, node] != node:
            side = scorer.left if row[scorer.features[scorer.feature[k, node]]] <= scorer.threshold[k, node] else scorer.right
            node = side[k, node]
        total += weight * scorer.value[k, node]
    return total


def calendar(day):
    doy = day.timetuple().tm_yday
    angle = 2 * math.pi * doy / 365.25
    return {
        "dow": day.weekday(), "month": day.month, "day": day.day, "quarter": (day.month + 2) // 3, "week_of_year": day.isocalendar()[1],
        "day_of_year": doy, "is_weekend": day.weekday() >= 5, "is_month_start": day.day <= 3, "is_month_end": day.day >= 28,
        "sin_doy_1": math.sin(angle), "cos_doy_1": math.cos(angle), "sin_doy_2": math.sin(2 * angle), "cos_doy_2": math.cos(2 * angle),
    }


def past(h, prefix=""):
    out = {f"{prefix}lag_{k}": h[-k] for k in {*e.LAGS, *e.BASE_LAGS}}
    for w in e.WINDOWS:
        out |= {f"{prefix}roll_mean_{w}": statistics.fmean(h[-w:]), f"{prefix}roll_std_{w}": statistics.stdev(h[-w:])}
        out |= {f"{prefix}roll_min_{w}": min(h[-w:]), f"{prefix}roll_max_{w}": max(h[-w:])}
    return out


def loop(dates, series, scorers, dual):
    """Rows of predictions of one series; ``series`` holds one list per target."""
    known = list(zip(dates, series[0]))
    series, out = [list(s) for s in series], []
    n = len(dates)
    for step in range(AHEAD):
        day = dates[-1] + dt.timedelta(days=step + 1)
        if n < 365:
            for s in series:
                s.append(max(s[-min(7, n)], 0.0))
            out.append([day, *[s[-1] for s in series], "short_history"])
            continue
        row = {**calendar(day), "trend_idx": n + step}
        if dual:
            rev, cogs = series
            row |= past(rev, "rev_") | past(cogs, "cogs_")
            row |= {"spread_lag_1": rev[-1] - cogs[-1], "spread_lag_7": rev[-7] - cogs[-7], "ratio_lag_1": cogs[-1] / max(rev[-1], 1.0)}
            row["ratio_roll_7"] = row["cogs_roll_mean_7"] / max(row["rev_roll_mean_7"], 1.0)
            for p, s in (("rev", rev), ("cogs", cogs)):
                row |= {f"{p}_mom_7": s[-1] - s[-7], f"{p}_mom_28": s[-1] - s[-28]}
        else:
            (h,) = series
            row |= past(h)
            row |= {"mom_7": h[-1] - h[-7], "mom_28": h[-1] - h[-28], "ratio_7_28": (row["roll_mean_7"] + 1) / (row["roll_mean_28"] + 1)}
            for name, part in (("dow_profile", dt.date.weekday), ("doy_profile", lambda d: d.timetuple().tm_yday)):
                values = [v for d, v in known if part(d) == part(day)]
                row[name] = statistics.median(values) if values else row["roll_mean_28"]
        answers = [max(walk(s, row), 0.0) for s in scorers]
        for s, answer in zip(series, answers):
            s.append(answer)
        out.append([day, *answers, "model"])
    return out


CASES = {
    "trees": ([trees(e.EXTENDED_FEATURES, 1)], False), "linear": ([linear(e.EXTENDED_FEATURES, 2)], False),
    "baseline": ([linear(e.BASELINE_FEATURES, 3)], False), "dual": ([trees(e.DUAL_FEATURES, 4), trees(e.DUAL_FEATURES, 5)], True),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("width", [2, 1024])
def test_rollout_against_loops(frame, monkeypatch, case, width):
    scorers, dual = CASES[case]
    monkeypatch.setattr(rollout, "WIDTH", width)
    if dual:
        got = f.recursive_dual_forecast(frame, AHEAD, *scorers, ["series"])
    else:
        got = f.recursive_forecast(frame, AHEAD, scorers[0], "revenue", ["series"])
    rows = frame.orderBy("date").collect()
    found = {}
    for r in got.collect():
        found.setdefault(r[0], []).append(r[1:])
    assert set(found) == set(LENGTHS)
    for name, mine in found.items():
        own = [r for r in rows if r.series == name]
        values = [[r.revenue for r in own], [r.cogs for r in own]][: 1 + dual]
        for a, b in zip(sorted(mine), loop([r.date for r in own], values, scorers, dual), strict=True):
            assert (a[0], a[-1]) == (b[0], b[-1])
            assert list(a[1:-1]) == pytest.approx(b[1:-1], rel=1e-9)


def test_one_series_without_keys(frame):
    scorer = CASES["trees"][0][0]
    one = frame.filter("series = 'a'").drop("series")
    got = f.recursive_forecast(one, 5, scorer).orderBy("date").collect()
    same = f.recursive_forecast(frame, 5, scorer, "revenue", ["series"]).filter("series = 'a'").orderBy("date").collect()
    assert [r.predicted for r in got] == [r.predicted for r in same] and got[0].__fields__ == ["date", "predicted", "status"]


def test_calendar_of_a_matrix_equals_the_columns(spark):
    days = spark.range(0, 4000, 7).select(F.date_add(F.lit("2011-12-25"), F.col("id").cast("int")).alias("date"))
    rows = days.select("date", *[c.alias(n) for n, c in calendar_columns().items()]).collect()
    mine = rollout.calendar_matrix(np.array([r.date for r in rows], dtype="datetime64[D]"))
    for name, values in mine.items():
        assert [float(v) for v in values] == pytest.approx([r[name] for r in rows], abs=1e-12)


def test_no_python_group_in_the_plan(frame):
    plan = f.recursive_forecast(frame, 5, CASES["trees"][0][0], "revenue", ["series"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
