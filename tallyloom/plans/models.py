"""Named queries for fitted models (F04-F13, B01-B08) and their explanation (V01-V05).

Linear models have SQL of their own (``linear_sql``). A fit of trees depends on how an engine draws samples
and splits, so its values have no SQL to be held against. Two queries of check rows have: every forecast covers
its days, and none is negative or empty. Tests hold the rest against plain loops and properties.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import backtest as b
from tallyloom.operators import boosting
from tallyloom.operators import explain as x
from tallyloom.operators import features as e
from tallyloom.operators import forecast as f
from tallyloom.operators import least_squares as ls
from tallyloom.operators.audit import output_contract, union_all
from tallyloom.plans import linear_sql as sql
from tallyloom.plans.catalog import query
from tallyloom.plans.common import daily_sales, once, only_one, panel_sales, rounded
from tallyloom.plans.series import _RANKED, _backtest, _metrics_sql, _naive_sql
from tallyloom.session import data_version

KEYS = ["series"]
HOLDOUT = 120
DUAL_HOLDOUT = 180
# Leaves, rows of a leaf, shares of rows and features, penalties. Fewer trees take larger steps.
DUAL_MODEL = boosting.LeafWise(
    trees=100, step=0.08, leaves=48, min_rows=20, row_share=0.82, column_share=0.82, l1=0.08, l2=0.12
)

# A fitted model serves every query of a session that needs it, as long as the files are the same.
_FITTED: dict[tuple, object] = {}


def _key(t, name: str) -> tuple:
    return (t.spark.sparkContext.applicationId, t.directory, data_version(t.spark, t.directory), name)


def fitted_all(t, fits: dict[str, Callable[[], object]]) -> dict[str, object]:
    """The named models, fitting the missing ones side by side. Names tell parameters apart."""
    keys = {name: _key(t, name) for name in fits}
    with only_one(*keys.values()):
        missing = {name: fit for name, fit in fits.items() if keys[name] not in _FITTED}
        for name, model in f.fit_all(missing).items():
            _FITTED[keys[name]] = model
    return {name: _FITTED[keys[name]] for name in fits}


def fitted(t, name: str, fit: Callable[[], object]):
    return fitted_all(t, {name: fit})[name]


def decided(t, name: str, decide: Callable[[], object]):
    """A choice that a comparison of models led to, made once."""
    key = _key(t, name)
    with only_one(key):
        if key not in _FITTED:
            _FITTED[key] = decide()
        return _FITTED[key]


def _label(params: dict) -> str:
    return ",".join(f"{k}={v}" for k, v in sorted(params.items()))


def chosen_candidate(t) -> dict:
    """Parameter set, best blend weight and model that the grid search ranks first."""

    def decide() -> dict:
        ranked = b07(t).collect()
        best = ranked[0]
        # The naive model has no parameters: its set is then the first one that follows with a model.
        with_model = next(r for r in ranked if r["model"] != "seasonal_year_lag365")
        of_set = [r for r in ranked if r["param_set"] == with_model["param_set"]]
        alpha = next(float(r["model"].rsplit("_", 1)[1]) for r in of_set if r["model"].startswith("blend_alpha_"))
        model = "blend" if best["model"].startswith("blend_alpha_") else best["model"]
        return {"params": f.PARAM_GRID[with_model["param_set"] - 1], "alpha": alpha, "model": model}

    return decided(t, "chosen", decide)


def _daily(t) -> DataFrame:
    return once(t, "daily_dense", lambda: daily_sales(t))


def _panel(t) -> DataFrame:
    return once(t, "panel_dense", lambda: panel_sales(t))


def _extended(t) -> DataFrame:
    """Causal features of the total series; they look backwards only, so one frame serves all cuts."""
    return once(
        t,
        "extended",
        lambda: e.supervised(e.extended_features(_daily(t)), e.EXTENDED_FEATURES, ["revenue"]),
    )


def _dual(t) -> DataFrame:
    return once(t, "dual", lambda: e.supervised(e.dual_features(_daily(t)), e.DUAL_FEATURES, ["revenue", "cogs"]))


def _linear_rows(t, keys=()) -> DataFrame:
    source = _panel(t) if keys else _daily(t)
    return e.supervised(e.baseline_features(source, "revenue", keys), e.BASELINE_FEATURES, ["revenue"], keys)


def _linear_models(t, keys=()) -> dict[int, f.Scorer]:
    """The models of the folds and, as the last, of all rows; solved from one pass over the rows."""

    def fit() -> dict[int, f.Scorer]:
        rows, columns = _linear_rows(t, keys), [*e.BASELINE_FEATURES, "revenue"]
        blocks = ls.moments(rows, columns, ls.fold_block(rows.select(F.max("date")).scalar(), f.HORIZON, f.N_FOLDS))
        out = {}
        for fold in range(1, f.N_FOLDS + 2):
            slopes, intercept = ls.up_to(blocks, fold).solve()
            out[fold] = f.Scorer(tuple(e.BASELINE_FEATURES), intercept, slopes)
        return out

    return fitted(t, f"linear{len(keys)}", fit)


def _linear(t, keys=()) -> f.Scorer:
    return _linear_models(t, keys)[f.N_FOLDS + 1]


def _fold_fits(t, name: str, rows: DataFrame, fit: Callable[[DataFrame], f.Scorer]) -> dict[str, Callable]:
    """One fit per fold from the rows before its validation window."""
    in_folds = f.training_rows(rows)
    return {f"{name}_fold{k}": lambda k=k: fit(in_folds.filter(F.col("fold_id") == k)) for k in (1, 2, 3)}


def _by_fold(models: dict[str, object], name: str) -> dict[int, f.Scorer]:
    return {k: models[f"{name}_fold{k}"] for k in (1, 2, 3)}


def _boosted_model(t, params: dict, rows: DataFrame, name: str):
    return fitted(t, f"{name}:{_label(params)}", lambda: f.fit_boosted(rows, e.EXTENDED_FEATURES, "revenue", params))


def _full_boosted(t, params: dict) -> f.Scorer:
    model = _boosted_model(t, params, _extended(t), "boosted_full")
    name = f"boosted_full_scorer:{_label(params)}"
    return fitted(t, name, lambda: f.boosted_scorer(model, e.EXTENDED_FEATURES, t.spark))


def _holdout_model(t):
    """The tuned model fitted without the last 120 days, and those days."""
    train, held = b.tail_split(_extended(t), HOLDOUT)
    return _boosted_model(t, chosen_candidate(t)["params"], train, "boosted_holdout"), train, held


def _dual_scorers(t, name: str) -> dict[str, f.Scorer]:
    """The models of both targets, without the last days ("holdout") or of all ("full"), grown together."""

    def fit() -> dict[str, f.Scorer]:
        rows = _dual(t)
        last = b.tail_split(rows, DUAL_HOLDOUT)[0].agg(F.max("date")).first()[0]
        targets = {f"full_{v}": F.col(v) for v in ("revenue", "cogs")}
        targets.update({f"holdout_{v}": F.when(F.col("date") <= F.lit(last), F.col(v)) for v in ("revenue", "cogs")})
        return boosting.fit(rows, e.DUAL_FEATURES, {n: (y, DUAL_MODEL) for n, y in targets.items()})

    models = fitted(t, f"dual:{DUAL_MODEL}", fit)
    return {v: models[f"{name}_{v}"] for v in ("revenue", "cogs")}


# Linear ----------------------------------------------------------------------------------------


@query("F04_linear_coefficients", sql.COEFFICIENTS)
def f04(t):
    """Coefficients of calendar columns are large and nearly collinear: compared in whole units."""
    scorer = _linear(t)
    rows = [*zip(scorer.features, map(float, scorer.coefficients)), ("intercept", scorer.intercept)]
    out = t.spark.createDataFrame(rows, "feature string, coefficient double")
    digits = F.when(F.col("feature").rlike("^(lag|roll)_"), F.round("coefficient", 6)).otherwise(F.round("coefficient", 0))
    return out.withColumn("coefficient", digits + 0.0)


def _linear_panel(t) -> DataFrame:
    return f.recursive_forecast(_panel(t), HOLDOUT, _linear(t, KEYS), "revenue", KEYS)


@query("F05_linear_recursive", f"{sql.rollout_text(HOLDOUT)} select series, date, round(predicted, 0) as predicted, 'model' as status from rolled")
def f05(t):
    """One pooled model, every segment series rolled out on its own."""
    return rounded(_linear_panel(t), {"predicted": 0})


_NAIVES = ["seasonal_week_lag7", "seasonal_year_lag365"]
_LINEAR = "linear_recursive_lagged"


@query(
    "F12_equal_weight_ensemble",
    f"""{sql.rollout_text(HOLDOUT)}, week as ({_naive_sql('v_dense', 'b.series, ', '', 7, 'revenue', HOLDOUT)}),
        year as ({_naive_sql('v_dense', 'b.series, ', '', 365, 'revenue', HOLDOUT)})
        select series, date, week.predicted as seasonal_week_lag7, year.predicted as seasonal_year_lag365,
            round(r.predicted, 0) as linear_recursive_lagged,
            round((week.predicted + year.predicted + r.predicted) / 3e0, 0) as ensemble_equal_weight
        from rolled r join week using (series, date) join year using (series, date)""",
)
def f12(t):
    panel = _panel(t)
    parts = {n: f.seasonal_naive(panel, HOLDOUT, s, "revenue", KEYS) for n, s in zip(_NAIVES, (7, 365))}
    wide = f.align({**parts, _LINEAR: _linear_panel(t)}, KEYS)
    wide = wide.withColumn("ensemble_equal_weight", f.equal_weight([*_NAIVES, _LINEAR]))
    return rounded(wide, {_LINEAR: 0, "ensemble_equal_weight": 0})


def _linear_backtest(t) -> DataFrame:
    """Weekly, yearly, linear and ensemble predictions of the three folds."""
    daily = _daily(t)
    scorers = {fold: scorer for fold, scorer in _linear_models(t).items() if fold <= f.N_FOLDS}
    train = f.training_rows(daily)
    parts = {name: f.seasonal_naive(train, f.HORIZON, s, "revenue", ["fold_id"]) for name, s in b.NAIVE_SEASONS.items()}
    parts[_LINEAR] = f.recursive_forecast_by_fold(train, f.HORIZON, scorers)
    wide = once(t, "linear_folds", lambda: f.align(parts, ["fold_id"]))
    wide = wide.withColumn("ensemble_equal_weight", f.equal_weight(list(parts)))
    lines = F.array(
        *[F.struct(F.lit(n).alias("model"), F.col(n).alias("predicted")) for n in [*parts, "ensemble_equal_weight"]]
    )
    actual = f.validation_rows(daily).select("fold_id", "date", F.col("revenue").alias("actual"))
    return wide.select("fold_id", "date", F.inline(lines)).join(actual, ["fold_id", "date"])


_FOLD_PREDICTIONS = f"""{sql.backtest_text()}, {_backtest('v_daily', '').replace('predictions as', 'naive as')},
    linear as (select cast(fold as integer) as fold_id, date, 'linear_recursive_lagged' as model, revenue as actual, predicted
        from rolled join v_daily using (date)),
    three as (select * from naive union all select * from linear),
    predictions as (select * from three union all
        select fold_id, date, 'ensemble_equal_weight' as model, any_value(actual) as actual, sum(predicted) / 3e0 as predicted
        from three group by fold_id, date)"""


@query("B01_model_backtest", f"{_FOLD_PREDICTIONS} select * replace (round(predicted, 0) as predicted) from predictions")
def b01_models(t):
    return rounded(_linear_backtest(t), {"predicted": 0})


def _linear_summary(t) -> DataFrame:
    return b.model_summary(b.metrics(_linear_backtest(t), ["fold_id", "model"]))


_COARSE = {"mae": 1, "rmse": 1, "r2": 6}


@query(
    "B04_model_comparison",
    f"""{_FOLD_PREDICTIONS}, m as ({_metrics_sql('fold_id, model')}), {_RANKED}
        select * replace (round(mae, 1) as mae, round(rmse, 1) as rmse, round(r2, 6) as r2) from summary""",
)
def b04_models(t):
    return rounded(_linear_summary(t), _COARSE)


# Boosted trees ---------------------------------------------------------------------------------


@query("F06_boosted_one_step")
def f06(t):
    model, _, held = _holdout_model(t)
    scored = model.transform(f.with_vector(held, e.EXTENDED_FEATURES))
    return scored.select("date", F.col("revenue").alias("actual"), F.col("prediction").alias("predicted"))


@query("F07_boosted_recursive")
def f07(t):
    """The parameter set that the grid search chose, fitted on all rows."""
    return f.recursive_forecast(_daily(t), t.horizon_days, _full_boosted(t, chosen_candidate(t)["params"]))


def _boosted_wide(t) -> DataFrame:
    return f.align({"gbt_recursive": f07(t), "seasonal_year_lag365": f.seasonal_naive(_daily(t), t.horizon_days, 365)})


@query("F08_boosted_blend")
def f08(t):
    blended = f.blend("gbt_recursive", "seasonal_year_lag365", chosen_candidate(t)["alpha"])
    return _boosted_wide(t).select("date", blended.alias("predicted"))


@query("F13_final_forecast")
def f13(t):
    """Forecast detail for every template day, with the model the grid search chose."""
    chosen = chosen_candidate(t)
    wide = _boosted_wide(t).withColumn("blend", f.blend("gbt_recursive", "seasonal_year_lag365", chosen["alpha"]))
    return f.forecast_detail(wide, ["gbt_recursive", "seasonal_year_lag365", "blend"], chosen["model"])


@query("F13_baseline_final")
def f13_baseline(t):
    """The four baseline candidates over the template, with the one the backtest ranks first."""
    best = decided(t, "baseline_best", lambda: b.best_model(_linear_summary(t)).first()["model"])
    daily, days = _daily(t), t.horizon_days
    parts = {name: f.seasonal_naive(daily, days, s) for name, s in b.NAIVE_SEASONS.items()}
    parts["linear_recursive_lagged"] = f.recursive_forecast(daily, days, _linear(t))
    wide = f.align(parts).withColumn("ensemble_equal_weight", f.equal_weight(list(parts)))
    return f.forecast_detail(wide, [*parts, "ensemble_equal_weight"], best)


_CONTRACT_SQL = "select 'forecast' as check_group, '{}' as check_name, 'PASS' as status, cast(0 as bigint) as failures, 'missing=0; extra=0; repeated=0; empty=0' as details"


@query("F13_output_contract", " union all ".join(_CONTRACT_SQL.format(n) for n in ("tuned", "baseline", "dual_revenue", "dual_cogs")))
def f13_contract(t):
    """The final forecasts against the template: every day once, with a value, and no other day."""
    dual = f11(t)
    finals = [("tuned", f13(t), "forecast_selected"), ("baseline", f13_baseline(t), "forecast_selected"),
              ("dual_revenue", dual, "revenue_final"), ("dual_cogs", dual, "cogs_final")]
    return union_all(output_contract(t.horizon(), df, value, name) for name, df, value in finals)


_SIGN_SQL = """select '{0}' as forecast, cast({1} as bigint) as rows, cast(0 as bigint) as negative, cast(0 as bigint) as not_finite
    from (select count(distinct series) as series from v_dense)"""


@query("F07_forecast_checks", " union all ".join([
    _SIGN_SQL.format("linear_by_segment", "series * 120"), _SIGN_SQL.format("tuned", "548"),
    _SIGN_SQL.format("baseline", "548"), _SIGN_SQL.format("dual_revenue", "548"), _SIGN_SQL.format("dual_cogs", "548"),
]))
def f07_checks(t):
    """Fitted forecasts: a row for every day and series, none negative, none without a finite value."""
    dual = f11(t)
    every = [("linear_by_segment", _linear_panel(t), "predicted"), ("tuned", f13(t), "forecast_selected"),
             ("baseline", f13_baseline(t), "forecast_selected"), ("dual_revenue", dual, "revenue_final"),
             ("dual_cogs", dual, "cogs_final")]

    def one(name: str, df: DataFrame, value: str) -> DataFrame:
        finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
        return df.agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col(value) < 0).alias("negative"), F.count_if(~finite).alias("not_finite")
        ).select(F.lit(name).alias("forecast"), "*")

    return union_all(one(*x) for x in every)


def _grid_predictions(t) -> DataFrame:
    """Each parameter set is fitted once per fold; blend weights are derived, not refitted."""
    daily = _daily(t)
    train = f.training_rows(daily)
    actual = f.validation_rows(daily).select("fold_id", "date", F.col("revenue").alias("actual"))
    seasonal = f.seasonal_naive(train, f.HORIZON, 365, "revenue", ["fold_id"])
    seasonal = seasonal.select("fold_id", "date", F.lit("seasonal_year_lag365").alias("model"), "predicted")
    rows = _extended(t)
    fits = {}
    for i, params in enumerate(f.PARAM_GRID, start=1):

        def fit(part, params=params):
            model = f.fit_boosted(part, e.EXTENDED_FEATURES, "revenue", params)
            return f.boosted_scorer(model, e.EXTENDED_FEATURES, t.spark)

        fits.update(_fold_fits(t, f"boosted_set{i}", rows, fit))
    models = fitted_all(t, fits)
    parts = []
    for i in range(1, len(f.PARAM_GRID) + 1):
        scorers = _by_fold(models, f"boosted_set{i}")
        rolled = f.recursive_forecast_by_fold(train, f.HORIZON, scorers)
        named = rolled.select("fold_id", "date", F.lit("gbt_recursive").alias("model"), "predicted")
        parts.append(named.unionByName(seasonal).withColumn("param_set", F.lit(i)))
    return reduce(DataFrame.unionByName, parts).join(actual, ["fold_id", "date"])


@query("B07_grid_search")
def b07(t):
    """Candidates of every parameter set and weight, best first."""
    predictions = once(t, "grid", lambda: _grid_predictions(t))
    blends = b.blend_predictions(
        predictions, "gbt_recursive", "seasonal_year_lag365", f.BLEND_ALPHAS, ["param_set", "fold_id"]
    ).drop("alpha")
    every = predictions.select("param_set", "fold_id", "date", "actual", "model", "predicted").unionByName(
        blends.select("param_set", "fold_id", "date", "actual", "model", "predicted")
    )
    per_fold = b.metrics(every, ["param_set", "fold_id", "model"])
    return b.model_summary(per_fold, ["param_set"]).orderBy("rmse", "mae", "composite_rank", "param_set", "model")


# Two targets -----------------------------------------------------------------------------------


@query("F09_dual_one_step")
def f09(t):
    """Both models on the held-out days, with true lags."""
    _, held = b.tail_split(_dual(t), DUAL_HOLDOUT)
    models = {f"{v}_pred": model for v, model in _dual_scorers(t, "holdout").items()}
    return boosting.predicted(held, models).select("date", "revenue", "cogs", *models)


@query("F10_dual_recursive")
def f10(t):
    """Models of all rows; predictions feed back as they are."""
    models = _dual_scorers(t, "full")
    return f.recursive_dual_forecast(_daily(t), t.horizon_days, models["revenue"], models["cogs"])


@query("F11_dual_post_processed")
def f11(t):
    daily = _daily(t)
    wide = f.align(
        {
            "revenue_seasonal": f.seasonal_naive(daily, t.horizon_days, 365),
            "cogs_seasonal": f.seasonal_naive(daily, t.horizon_days, 365, "cogs"),
        }
    ).join(f10(t), "date")
    alpha = decided(t, "dual_alpha", lambda: float(b08(t).first()["alpha"]))
    blended = wide.select(
        "date",
        "revenue_raw",
        "revenue_seasonal",
        "cogs_raw",
        "cogs_seasonal",
        f.blend("revenue_raw", "revenue_seasonal", alpha).alias("revenue_final"),
        f.blend("cogs_raw", "cogs_seasonal", alpha).alias("cogs_final"),
    )
    return f.post_process(blended, "revenue_final", "cogs_final")


@query("B08_dual_blend_weights")
def b08(t):
    """Weights judged on a recursive forecast of the holdout, the way they will be used."""
    models = _dual_scorers(t, "holdout")
    train, held = b.tail_split(_daily(t), DUAL_HOLDOUT)
    wide = f.align(
        {
            "revenue_seasonal": f.seasonal_naive(train, DUAL_HOLDOUT, 365),
            "cogs_seasonal": f.seasonal_naive(train, DUAL_HOLDOUT, 365, "cogs"),
        }
    ).join(f.recursive_dual_forecast(train, DUAL_HOLDOUT, models["revenue"], models["cogs"]), "date")
    judged = once(t, "dual_judged", lambda: held.join(wide, "date"))
    return b.blend_weights(judged, f.DUAL_ALPHAS)


# Explanation -----------------------------------------------------------------------------------


@query("V01_feature_importance")
def v01(t):
    model, _, _ = _holdout_model(t)
    return x.feature_importance(model, e.EXTENDED_FEATURES, t.spark, top_n=20)


@query("V02_grouped_importance")
def v02(t):
    model, _, _ = _holdout_model(t)
    return x.grouped_importance(x.feature_importance(model, e.EXTENDED_FEATURES, t.spark), e.FEATURE_GROUPS)


@query("V03_permutation_importance")
def v03(t):
    model, _, held = _holdout_model(t)
    return x.permutation_importance(model, held, e.EXTENDED_FEATURES, "revenue")


@query("V04_partial_dependence")
def v04(t):
    model, train, _ = _holdout_model(t)
    shares = model.featureImportances.toArray()
    top = sorted(range(len(shares)), key=lambda i: (-shares[i], e.EXTENDED_FEATURES[i]))[:3]
    return x.partial_dependence(model, train, e.EXTENDED_FEATURES, [e.EXTENDED_FEATURES[i] for i in top])


@query("V05_holdout_metrics")
def v05(t):
    """Metrics of the tuned model, and the blend weight that goes with it."""
    model, _, held = _holdout_model(t)
    summary = x.holdout_summary(model, held, e.EXTENDED_FEATURES, "revenue")
    weight = t.spark.range(1).select(
        F.lit("grid_search").alias("kind"), F.lit("best_blend_alpha").alias("metric"),
        F.lit(chosen_candidate(t)["alpha"]).alias("value"),
    )
    return summary.unionByName(weight)
