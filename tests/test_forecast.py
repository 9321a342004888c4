"""Closed forms against loops, Spark models against their array form, rollouts against a driver loop."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import backtest as b
from tallyloom.operators import explain as x
from tallyloom.operators import features as e
from tallyloom.operators import forecast as f

START = dt.date(2015, 1, 1)
DAYS = 800
KEYS = ["series"]


def planted(i, level):
    return level + 0.05 * i + 20 * math.sin(2 * math.pi * i / 365.25) + 8 * (i % 7 in (5, 6)) + (i * 7919 % 13) * 0.3


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for name, level in (("a", 100.0), ("b", 300.0)):
        for i in range(DAYS):
            v = planted(i, level)
            rows.append((name, START + dt.timedelta(days=i), v, 0.6 * v + (i % 5)))
    return spark.createDataFrame(rows, "series string, date date, revenue double, cogs double").cache()


def history(panel, series, column="revenue"):
    rows = panel.filter(F.col("series") == series).orderBy("date").collect()
    return [r[column] for r in rows]


@pytest.mark.parametrize("season", [7, 365])
@pytest.mark.parametrize("days", [3, 548])
def test_seasonal_naive_equals_the_recursive_loop(panel, season, days):
    got = f.seasonal_naive(panel, days, season, "revenue", KEYS)
    for s in ("a", "b"):
        hist, want = history(panel, s), []
        for _ in range(days):
            want.append(hist[-season])
            hist.append(hist[-season])
        rows = got.filter(F.col("series") == s).orderBy("date").collect()
        assert [r.predicted for r in rows] == want
        assert rows[0].date == START + dt.timedelta(days=DAYS)


def test_folds_are_contiguous_and_end_on_the_last_day(panel):
    folds = f.build_folds(panel, 120, 3).orderBy("fold_id").collect()
    assert folds[-1].valid_end == START + dt.timedelta(days=DAYS - 1)
    for a_, b_ in zip(folds, folds[1:]):
        assert b_.valid_start == a_.valid_end + dt.timedelta(days=1) and b_.train_end == a_.valid_end
    counts = f.validation_rows(panel).groupBy("fold_id", "series").count().collect()
    assert len(counts) == 6 and {c["count"] for c in counts} == {120}
    trained = {r.fold_id: r.m for r in f.training_rows(panel).groupBy("fold_id").agg(F.max("date").alias("m")).collect()}
    assert trained == {r.fold_id: r.train_end for r in folds}


@pytest.fixture(scope="module")
def linear(panel):
    rows = e.supervised(e.baseline_features(panel, "revenue", KEYS), e.BASELINE_FEATURES, ["revenue"], KEYS)
    return rows.cache(), f.linear_scorer(f.fit_linear(rows, e.BASELINE_FEATURES, "revenue"), e.BASELINE_FEATURES)


def test_linear_model_is_least_squares(linear):
    rows, scorer = linear
    pdf = rows.toPandas()
    design = np.column_stack([pdf[list(e.BASELINE_FEATURES)].to_numpy(), np.ones(len(pdf))])
    best = np.linalg.lstsq(design, pdf["revenue"].to_numpy(), rcond=None)[0]
    mine = design @ np.append(scorer.coefficients, scorer.intercept)
    assert np.abs(mine - design @ best).max() < 1e-3


def test_linear_rollout_equals_a_driver_loop(panel, linear):
    _, scorer = linear
    got = f.recursive_forecast(panel, 30, scorer, "revenue", KEYS)
    for s in ("a", "b"):
        hist = history(panel, s)
        for step in range(30):
            day = START + dt.timedelta(days=DAYS + step)
            doy = day.timetuple().tm_yday
            row = {
                "dow": day.weekday(), "month": day.month, "day": day.day, "day_of_year": doy,
                "sin_doy_1": math.sin(2 * math.pi * doy / 365.25), "cos_doy_1": math.cos(2 * math.pi * doy / 365.25),
                "trend_idx": DAYS + step, "roll_mean_7": np.mean(hist[-7:]), "roll_mean_28": np.mean(hist[-28:]),
            }
            row.update({f"lag_{k}": hist[-k] for k in e.BASE_LAGS})
            hist.append(max(float(scorer.coefficients @ np.array([row[n] for n in scorer.features]) + scorer.intercept), 0.0))
        rows = got.filter(F.col("series") == s).orderBy("date").collect()
        assert [r.predicted for r in rows] == pytest.approx(hist[DAYS:], rel=1e-9)


@pytest.fixture(scope="module")
def boosted(spark, panel):
    rows = e.supervised(e.extended_features(panel, "revenue", KEYS), e.EXTENDED_FEATURES, ["revenue"], KEYS).cache()
    params = {"maxIter": 12, "stepSize": 0.3, "maxDepth": 3, "subsamplingRate": 0.9, "minInstancesPerNode": 5}
    model = f.fit_boosted(rows, e.EXTENDED_FEATURES, "revenue", params)
    return rows, model, f.boosted_scorer(model, e.EXTENDED_FEATURES, spark)


def test_array_form_of_the_trees_equals_the_model(boosted):
    rows, model, scorer = boosted
    scored = model.transform(f.with_vector(rows, e.EXTENDED_FEATURES)).select("features", "prediction").collect()
    worst = max(abs(scorer.predict(r.features.toArray()) - r.prediction) for r in scored)
    assert worst < 1e-9


def test_first_rollout_step_sees_the_window_features(spark, panel, boosted):
    """The first predicted day uses what the windows would show for that day."""
    _, model, scorer = boosted
    first = f.recursive_forecast(panel, 1, scorer, "revenue", KEYS).collect()
    day = START + dt.timedelta(days=DAYS)
    extra = spark.createDataFrame([("a", day, 0.0, 0.0), ("b", day, 0.0, 0.0)], panel.schema)
    rows = e.extended_features(panel.unionByName(extra), "revenue", KEYS).filter(F.col("date") == day)
    want = {r.series: r.prediction for r in model.transform(f.with_vector(rows, e.EXTENDED_FEATURES)).collect()}
    assert {r.series: r.predicted for r in first} == pytest.approx(want, rel=1e-9)


def test_boosted_rollout_beats_the_weekly_naive_and_is_never_negative(panel):
    train, held = b.tail_split(panel, 60, KEYS)
    rows = e.supervised(e.extended_features(train, "revenue", KEYS), e.EXTENDED_FEATURES, ["revenue"], KEYS)
    params = {"maxIter": 40, "stepSize": 0.2, "maxDepth": 4, "subsamplingRate": 0.9, "minInstancesPerNode": 5}
    scorer = f.boosted_scorer(f.fit_boosted(rows, e.EXTENDED_FEATURES, "revenue", params), e.EXTENDED_FEATURES, panel.sparkSession)
    rolled = f.recursive_forecast(train, 60, scorer, "revenue", KEYS)
    naive = f.seasonal_naive(train, 60, 7, "revenue", KEYS)
    both = f.align({"gbt": rolled, "naive": naive}, KEYS).join(held, [*KEYS, "date"])
    row = both.agg(
        F.avg(F.abs(F.col("gbt") - F.col("revenue"))).alias("g"), F.avg(F.abs(F.col("naive") - F.col("revenue"))).alias("n"),
        F.min("gbt").alias("low"), F.count(F.lit(1)).alias("c"),
    ).collect()[0]
    assert row.c == 120 and row.low >= 0 and row.g < row.n


def test_dual_rollout_feeds_both_targets(panel):
    rows = e.supervised(e.dual_features(panel, KEYS), e.DUAL_FEATURES, ["revenue", "cogs"], KEYS)
    fit = lambda target: f.linear_scorer(f.fit_linear(rows, e.DUAL_FEATURES, target), e.DUAL_FEATURES)
    rev, cogs = fit("revenue"), fit("cogs")
    out = f.recursive_dual_forecast(panel, 5, rev, cogs, KEYS)
    # The second day equals a one-day forecast from a history that holds the first prediction.
    first = out.filter(F.col("date") == START + dt.timedelta(days=DAYS))
    longer = panel.unionByName(first.select("series", "date", F.col("revenue_raw").alias("revenue"), F.col("cogs_raw").alias("cogs")))
    again = f.recursive_dual_forecast(longer, 1, rev, cogs, KEYS)
    want = {r.series: (r.revenue_raw, r.cogs_raw) for r in again.collect()}
    got = {r.series: (r.revenue_raw, r.cogs_raw) for r in out.filter(F.col("date") == START + dt.timedelta(days=DAYS + 1)).collect()}
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-9)


def test_series_without_a_year_of_history_repeats_its_last_week(panel, linear):
    short = panel.filter((F.col("series") == "a") | (F.col("date") > START + dt.timedelta(days=DAYS - 100)))
    got = f.recursive_forecast(short, 9, linear[1], "revenue", KEYS).orderBy("series", "date").collect()
    assert {(r.series, r.status) for r in got} == {("a", f.BY_MODEL), ("b", f.SHORT_HISTORY)} and len(got) == 18
    week = [r.revenue for r in panel.filter("series = 'b'").orderBy(F.col("date").desc()).limit(7).collect()][::-1]
    assert [r.predicted for r in got if r.series == "b"] == pytest.approx([*week, *week][:9])
    # A candidate without a value for a day does not take the others with it.
    wide = f.align({"model": f.recursive_forecast(short, 9, linear[1], "revenue", KEYS), "year": f.seasonal_naive(short, 9, 365, "revenue", KEYS)}, KEYS)
    mean = wide.withColumn("mean", f.equal_weight(["model", "year"])).filter("series = 'b'").collect()
    assert len(mean) == 9 and all(r["mean"] is not None for r in mean)


def test_post_processing_caps_cost_below_revenue(spark):
    df = spark.createDataFrame([(-5.0, 3.0), (10.0, 20.0), (10.0, 4.0)], "revenue double, cogs double")
    got = [(r.revenue, r.cogs) for r in f.post_process(df, "revenue", "cogs").collect()]
    assert got == [(0.0, 0.0), (10.0, pytest.approx(9.99)), (10.0, 4.0)]


def test_metrics_and_zero_variance(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0), ("m", 3.0, 3.0), ("flat", 2.0, 1.0), ("flat", 2.0, 3.0)], "model string, actual double, predicted double")
    got = {r.model: r for r in b.metrics(df, ["model"]).collect()}
    assert (got["m"].mae, got["m"].rmse, got["m"].r2) == (0.5, pytest.approx(math.sqrt(0.5)), pytest.approx(0.5))
    assert got["flat"].r2 is None


def test_summary_ranks_ties_together_and_picks_by_name(spark):
    df = spark.createDataFrame([("b", 1.0, 1.0, 0.5), ("a", 1.0, 1.0, 0.5), ("c", 2.0, 3.0, 0.1)], "model string, mae double, rmse double, r2 double")
    summary = b.model_summary(df)
    assert [(r.model, r.composite_rank) for r in summary.collect()] == [("a", 1.0), ("b", 1.0), ("c", 2.0)]
    assert b.best_model(summary).collect()[0].model == "a"


def test_fold_model_keeps_folds_apart(panel, linear):
    train = f.training_rows(panel)
    got = f.recursive_forecast_by_fold(train, 10, {1: linear[1], 3: linear[1]}, "revenue", KEYS)
    assert {(r.fold_id, r.series) for r in got.collect()} == {(1, "a"), (1, "b"), (3, "a"), (3, "b")}


def test_importance_finds_the_planted_feature(spark):
    rows = [(float(i % 17), float(i * 31 % 23), 5.0 * (i % 17)) for i in range(400)]
    df = spark.createDataFrame(rows, "signal double, noise double, y double")
    model = f.fit_boosted(df, ["signal", "noise"], "y", {"maxIter": 10, "maxDepth": 4, "stepSize": 0.3})
    ranked = x.feature_importance(model, ["signal", "noise"], spark).orderBy("rank").collect()
    assert ranked[0].feature == "signal" and sum(r.importance_share for r in ranked) == pytest.approx(1.0)
    groups = {r.group: r for r in x.grouped_importance(x.feature_importance(model, ["signal", "noise"], spark), {"g": ["signal"]}).collect()}
    assert groups["g"].top_feature == "signal" and groups["other"].feature_count == 1
    perm = {r.feature: r for r in x.permutation_importance(model, df, ["signal", "noise"], "y", repeats=3).collect()}
    assert perm["signal"].rank == 1 and perm["signal"].perm_importance_mean > 10 * abs(perm["noise"].perm_importance_mean)
    curve = x.partial_dependence(model, df, ["signal", "noise"], ["signal"]).orderBy("point").collect()
    assert len(curve) == 9
    assert [c.grid_value for c in curve] == pytest.approx(list(np.quantile([r[0] for r in rows], np.linspace(0.05, 0.95, 9))))
    assert curve[-1].avg_prediction > curve[0].avg_prediction + 40
    assert {r.metric for r in x.holdout_summary(model, df, ["signal", "noise"], "y").collect()} == {"mae", "rmse", "r2"}


def test_permutation_and_dependence_against_whole_scoring(boosted):
    """Only some trees are walked again, and leaves are counted: the same as scoring every changed row whole."""
    rows, model, scorer = boosted
    names, repeats = list(e.EXTENDED_FEATURES), 2
    held = rows.orderBy("date").limit(60)
    pairs = x.shuffled_rows(held, names, "revenue", repeats, f.SEED).collect()
    assert len(pairs) == 60 * repeats
    got = {r.feature: r for r in x.permutation_importance(model, held, names, "revenue", repeats).collect()}
    assert len(got) == len(names) and sum(r.perm_importance_mean == 0 for r in got.values()) > 3
    for j, name in enumerate(names):
        drops = []
        for r in range(1, repeats + 1):
            own = [p for p in pairs if p["_r"] == r]
            x0, other, y = (np.array([p[c] for p in own]) for c in ("_x", "_other", "_y"))
            assert sorted(x0[:, j]) == sorted(other[:, j])
            changed = x0.copy()
            changed[:, j] = other[:, j]
            rmse = [math.sqrt(np.mean((y - scorer.predict_many(m)) ** 2)) for m in (x0, changed)]
            drops.append(rmse[1] - rmse[0])
        assert got[name].perm_importance_mean == pytest.approx(np.mean(drops), rel=1e-9, abs=1e-9)
        assert got[name].perm_importance_std == pytest.approx(np.std(drops), rel=1e-9, abs=1e-9)
    which = ["lag_1", "trend_idx", "roll_mean_7", "is_weekend"]
    curve = x.partial_dependence(model, held, names, which).collect()
    assert len(curve) == 9 * len(which)
    whole = np.array([[float(r[n]) for n in names] for r in held.collect()])
    for c in curve:
        changed = whole.copy()
        changed[:, names.index(c.feature)] = c.grid_value
        assert c.avg_prediction == pytest.approx(scorer.predict_many(changed).mean(), rel=1e-9)


def test_new_data_in_the_same_folder_is_fitted_again(spark, tmp_path):
    from types import SimpleNamespace

    from tallyloom.plans import models

    folder, fits = tmp_path / "tables", []
    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(str(folder))
        for _ in range(2):
            t = SimpleNamespace(spark=spark, directory=str(folder))
            models.fitted(t, "m", lambda n=n: fits.append(n) or n)
    assert fits == [3, 5]


def test_the_final_forecast_follows_the_grid_search(spark, monkeypatch):
    """When the second parameter set wins, it is fitted, and its weight and model are used."""
    from tallyloom.plans import models
    from tallyloom.sources.tables import StarTables

    from .conftest import DATA

    ranked = spark.createDataFrame(
        [(2, "blend_alpha_0.75", 1), (1, "blend_alpha_0.90", 2), (2, "gbt_recursive", 3)], "param_set int, model string, place int"
    ).coalesce(1).orderBy("place")
    monkeypatch.setattr(models, "b07", lambda t: ranked)
    monkeypatch.setattr(models, "_FITTED", {})
    seen = []
    real = f.fit_boosted
    quick = lambda rows, names, target, params: seen.append(params) or real(rows, names, target, {"maxIter": 2, "maxDepth": 2})
    monkeypatch.setattr(f, "fit_boosted", quick)
    out = models.f13(StarTables(spark, DATA))
    row = out.first()
    assert seen == [f.PARAM_GRID[1]] and row.selected_model == "blend"
    assert row.forecast_selected == pytest.approx(max(0.75 * row.forecast_gbt_recursive + 0.25 * row.forecast_seasonal_year_lag365, 0))
