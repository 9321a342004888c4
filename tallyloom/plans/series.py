"""Named queries E, Y, F and B that plain SQL can express: features, decomposition, naive backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import backtest as b
from tallyloom.operators import decompose as y
from tallyloom.operators import features as e
from tallyloom.operators import forecast as f
from tallyloom.operators import relational as r
from tallyloom.operators import scenario as sc
from tallyloom.plans.catalog import query
from tallyloom.plans.common import daily_sales, panel_sales, rounded

KEYS = ["series"]
DAYS = 548

# Features --------------------------------------------------------------------------------------

_CAL_SQL = {
    "dow": "cast(isodow(date) - 1 as double)",
    "month": "cast(month(date) as double)",
    "day": "cast(day(date) as double)",
    "quarter": "cast(quarter(date) as double)",
    "week_of_year": "cast(weekofyear(date) as double)",
    "day_of_year": "cast(dayofyear(date) as double)",
    "is_weekend": "case when isodow(date) >= 6 then 1e0 else 0e0 end",
    "is_month_start": "case when day(date) <= 3 then 1e0 else 0e0 end",
    "is_month_end": "case when day(date) >= 28 then 1e0 else 0e0 end",
    "sin_doy_1": "round(sin(2 * pi() * dayofyear(date) / 365.25e0), 9)",
    "cos_doy_1": "round(cos(2 * pi() * dayofyear(date) / 365.25e0), 9)",
    "sin_doy_2": "round(sin(4 * pi() * dayofyear(date) / 365.25e0), 9)",
    "cos_doy_2": "round(cos(4 * pi() * dayofyear(date) / 365.25e0), 9)",
}
_HARMONICS = {c: 9 for c in ("sin_doy_1", "cos_doy_1", "sin_doy_2", "cos_doy_2")}
_STEP = "cast(row_number() over (partition by series order by date) - 1 as double)"


def _lag_sql(value: str, k: int) -> str:
    return f"lag({value}, {k}) over (partition by series order by date)"


_SQL_STAT = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


def _roll_sql(value: str, w: int, stat: str) -> str:
    frame = f"(partition by series order by date rows between {w} preceding and 1 preceding)"
    return f"case when count({value}) over {frame} = {w} then {_SQL_STAT[stat]}({value}) over {frame} end"


def _rolls(value: str, windows, stats, prefix: str = "") -> dict[str, str]:
    return {f"{prefix}roll_{s}_{w}": _roll_sql(value, w, s) for w in windows for s in stats}


def _lags(value: str, ks, prefix: str = "") -> dict[str, str]:
    return {f"{prefix}lag_{k}": _lag_sql(value, k) for k in ks}


def _stat_digits(names) -> dict[str, int]:
    return {n: 4 for n in names if "_mean_" in n or "_std_" in n}


def _select(columns: dict[str, str], source: str, digits: dict[str, int] | None = None) -> str:
    digits = digits or {}
    parts = [f"round({c} + 1e-7, {digits[n]}) as {n}" if n in digits else f"{c} as {n}" for n, c in columns.items()]
    return f"select series, date, {', '.join(parts)} from {source}"


@query(
    "E01_basic_calendar",
    _select({**{c: _CAL_SQL[c] for c in e.BASIC_CALENDAR}, "trend_idx": _STEP}, "v_dense"),
)
def e01(t):
    out = e.basic_calendar(panel_sales(t), KEYS).drop("revenue", "cogs")
    return rounded(out, {c: 9 for c in ("sin_doy_1", "cos_doy_1")})


@query("E02_extended_calendar", _select({**_CAL_SQL, "trend_idx": _STEP}, "v_dense"))
def e02(t):
    return rounded(e.extended_calendar(panel_sales(t), KEYS).drop("revenue", "cogs"), _HARMONICS)


_E03 = {**_lags("revenue", e.BASE_LAGS), **_rolls("revenue", e.BASE_MEANS, ("mean",))}


@query("E03_baseline_lags", _select(_E03, "v_dense", _stat_digits(_E03)))
def e03(t):
    out = e.baseline_features(panel_sales(t), "revenue", KEYS).select("series", "date", *_E03)
    return rounded(out, _stat_digits(_E03), nudge=1e-7)


@query("E04_extended_lags", _select(_lags("revenue", e.LAGS), "v_dense"))
def e04(t):
    return panel_sales(t).withColumns(e.lags("revenue", KEYS)).drop("revenue", "cogs")


_E05 = _rolls("revenue", e.WINDOWS, e.STATS)


@query("E05_rolling_statistics", _select(_E05, "v_dense", _stat_digits(_E05)))
def e05(t):
    out = panel_sales(t).withColumns(e.rolling("revenue", KEYS)).drop("revenue", "cogs")
    return rounded(out, _stat_digits(_E05), nudge=1e-7)


_MOM_BASE = {**_lags("revenue", (1, 7, 28)), **_rolls("revenue", (7, 28), ("mean",))}


@query(
    "E06_momentum",
    "select series, date, lag_1 - lag_7 as mom_7, lag_1 - lag_28 as mom_28, "
    "round((roll_mean_7 + 1e0) / nullif(roll_mean_28 + 1e0, 0), 9) as ratio_7_28 from ("
    + _select(_MOM_BASE, "v_dense")
    + ")",
)
def e06(t):
    base = panel_sales(t).withColumns(
        {**e.lags("revenue", KEYS, (1, 7, 28)), **e.rolling("revenue", KEYS, (7, 28), ("mean",))}
    )
    return rounded(base.withColumns(e.momentum()).select("series", "date", *e.MOMENTUM), {"ratio_7_28": 9})


@query(
    "E07_whole_series_profiles",
    """select series, date, round(median(revenue) over (partition by series, isodow(date)) + 1e-7, 4) as dow_profile,
       round(median(revenue) over (partition by series, dayofyear(date)) + 1e-7, 4) as doy_profile from v_dense""",
)
def e07(t):
    out = panel_sales(t).withColumns(e.whole_profiles("revenue", KEYS)).drop("revenue", "cogs")
    return rounded(out, {"dow_profile": 4, "doy_profile": 4}, nudge=1e-7)


_PAST = "order by date rows between unbounded preceding and 1 preceding"


@query(
    "E08_causal_profiles",
    f"""select series, date, round(median(revenue) over (partition by series, isodow(date) {_PAST}) + 1e-7, 4) as dow_profile,
        round(median(revenue) over (partition by series, dayofyear(date) {_PAST}) + 1e-7, 4) as doy_profile from v_dense""",
)
def e08(t):
    out = panel_sales(t).withColumns(e.causal_profiles("revenue", KEYS)).drop("revenue", "cogs")
    return rounded(out, {"dow_profile": 4, "doy_profile": 4}, nudge=1e-7)


_E09 = {
    **_lags("revenue", e.LAGS, "rev_"),
    **_lags("cogs", e.LAGS, "cogs_"),
    **_rolls("revenue", e.WINDOWS, e.STATS, "rev_"),
    **_rolls("cogs", e.WINDOWS, e.STATS, "cogs_"),
}


@query("E09_dual_target_features", _select(_E09, "v_dense", _stat_digits(_E09)))
def e09(t):
    out = e.dual_features(panel_sales(t), KEYS).select("series", "date", *_E09)
    return rounded(out, _stat_digits(_E09), nudge=1e-7)


@query(
    "E10_cross_target_features",
    "select series, date, rev_lag_1 - cogs_lag_1 as spread_lag_1, rev_lag_7 - cogs_lag_7 as spread_lag_7, "
    "round(cogs_lag_1 / greatest(rev_lag_1, 1e0), 9) as ratio_lag_1, "
    "round(cogs_roll_mean_7 / greatest(rev_roll_mean_7, 1e0), 9) as ratio_roll_7, "
    "rev_lag_1 - rev_lag_7 as rev_mom_7, rev_lag_1 - rev_lag_28 as rev_mom_28, "
    "cogs_lag_1 - cogs_lag_7 as cogs_mom_7, cogs_lag_1 - cogs_lag_28 as cogs_mom_28 from ("
    + _select(
        {
            **_lags("revenue", (1, 7, 28), "rev_"),
            **_lags("cogs", (1, 7, 28), "cogs_"),
            **_rolls("revenue", (7,), ("mean",), "rev_"),
            **_rolls("cogs", (7,), ("mean",), "cogs_"),
        },
        "v_dense",
    )
    # SQL greatest() skips nulls in one engine and not in the other: keep rows that have a past.
    + ") where rev_lag_1 is not null and rev_roll_mean_7 is not null",
)
def e10(t):
    out = e.dual_features(panel_sales(t), KEYS).filter("rev_lag_1 is not null and rev_roll_mean_7 is not null")
    return rounded(out.select("series", "date", *e.CROSS_FEATURES), {"ratio_lag_1": 9, "ratio_roll_7": 9})


@query(
    "E11_supervised_matrix",
    "select series, date, revenue, lag_1, lag_365, roll_mean_28 from ("
    + _select(
        {
            "revenue": "revenue",
            "step": _STEP,
            "lag_1": _lag_sql("revenue", 1),
            "lag_365": _lag_sql("revenue", 365),
            "roll_mean_28": _roll_sql("revenue", 28, "mean"),
        },
        "v_dense",
        {"roll_mean_28": 4},
    )
    + ") where step >= 365",
)
def e11(t):
    rows = e.supervised(e.extended_features(panel_sales(t), "revenue", KEYS), e.EXTENDED_FEATURES, ["revenue"], KEYS)
    out = rows.select("series", "date", "revenue", "lag_1", "lag_365", "roll_mean_28")
    return rounded(out, {"roll_mean_28": 4}, nudge=1e-7)


# Decomposition ---------------------------------------------------------------------------------


def _parts(source: str, keys: str) -> str:
    comma = f"{keys}, " if keys else ""
    part = f"partition by {keys}" if keys else ""
    full = f"({part} order by date rows between 182 preceding and 182 following)"
    return f"""numbered as (select {comma}date, revenue, cast(row_number() over ({part} order by date) - 1 as double) as step from {source}),
    trended as (select {comma}date, revenue, coalesce(case when count(*) over {full} = 365 then
        cast(sum(cast(revenue as decimal(18,4))) over {full} as double) / 365e0 end,
        regr_intercept(revenue, step) over ({part}) + regr_slope(revenue, step) over ({part}) * step) as trend from numbered),
    parts as (select *, revenue - trend as detrended, median(revenue - trend) over (partition by {comma}dayofyear(date)) as seasonality
        from trended),
    decomposed as (select {comma}date, revenue, trend, detrended, seasonality, detrended - seasonality as promotional,
        revenue - (trend + seasonality + (detrended - seasonality)) as residual from parts)"""


_TOTAL_PARTS = _parts("v_daily", "")
_PANEL_PARTS = _parts("v_dense", "series")


@query("Y01_trend", f"with {_TOTAL_PARTS} select date, revenue, round(trend, 2) as trend from decomposed")
def y01(t):
    return rounded(y.trend(daily_sales(t)).select("date", "revenue", "trend"), {"trend": 2})


@query(
    "Y02_seasonality",
    f"""with {_PANEL_PARTS} select series, date, round(trend, 2) as trend, round(detrended, 2) as detrended,
        round(seasonality, 2) as seasonality from decomposed""",
)
def y02(t):
    out = y.decompose(panel_sales(t), "revenue", KEYS)
    return rounded(
        out.select("series", "date", "trend", "detrended", "seasonality"), {"trend": 2, "detrended": 2, "seasonality": 2}
    )


@query(
    "Y03_promotional_and_residual",
    f"""with {_TOTAL_PARTS} select date, round(promotional, 2) as promotional, abs(round(residual, 2)) as residual from decomposed""",
)
def y03(t):
    out = y.decompose(daily_sales(t)).select("date", "promotional", F.abs(F.round("residual", 2)).alias("residual"))
    return rounded(out, {"promotional": 2})


_SHARES = f"""{_TOTAL_PARTS}, totals as (select var_samp(revenue) as total, var_samp(trend) as trend,
    var_samp(seasonality) as seasonality, var_samp(promotional) as promotional, var_samp(residual) as residual from decomposed),
    shares as (""" + " union all ".join(
    f"select '{c}' as component, {c} as variance, coalesce({c} / nullif(total, 0), 0e0) as pct_total from totals"
    for c in y.COMPONENTS
) + ")"


@query(
    "Y04_variance_shares",
    f"with {_SHARES} select component, abs(round(variance, -3)) as variance, round(pct_total, 9) as pct_total from shares",
)
def y04(t):
    out = y.variance_shares(y.decompose(daily_sales(t)))
    return rounded(out, {"variance": -3, "pct_total": 9})


_TRAIN = """scalars as (select arg_min(revenue, date) as first_value, arg_max(revenue, date) as last_value, count(*) as n,
    cast(sum(cast(revenue as decimal(18,4))) as double) / count(*) as mean_value, median(revenue) as median_value,
    max(date) as last_date from v_daily),
    by_day as (select dayofyear(date) as doy, median(revenue) as day_median from v_daily group by 1),
    ahead as (select cast(last_date + h as date) as date, h as step, s.* from scalars s,
        (select unnest(generate_series(1, 548))::integer as h)),
    methods as (select date, first_value + (last_value - first_value) / n * step as forecast_drift,
        coalesce(day_median, median_value) as forecast_seasonal_naive,
        mean_value + coalesce(day_median, 0e0) as forecast_trend_seasonal
        from ahead left join by_day on doy = dayofyear(date)),
    ensemble as (select *, (forecast_drift + forecast_seasonal_naive + forecast_trend_seasonal) / 3e0 as forecast_ensemble from methods)"""

_FORECASTS = ("forecast_drift", "forecast_seasonal_naive", "forecast_trend_seasonal", "forecast_ensemble")


def _forecast(t):
    return y.ensemble_forecast(daily_sales(t), DAYS)


def _one_method(name: str, column: str):
    @query(name, f"with {_TRAIN} select date, round({column} + 1e-7, 4) as {column} from ensemble")
    def build(t):
        return rounded(_forecast(t).select("date", column), {column: 4}, nudge=1e-7)

    return build


y05 = _one_method("Y05_drift_forecast", "forecast_drift")
y06 = _one_method("Y06_day_of_year_median_forecast", "forecast_seasonal_naive")
y07 = _one_method("Y07_level_plus_season_forecast", "forecast_trend_seasonal")
y08 = _one_method("Y08_ensemble_forecast", "forecast_ensemble")


@query(
    "Y07_detrended_level_forecast",
    f"""with {_TOTAL_PARTS}, effect as (select dayofyear(date) as doy, median(detrended) as e from decomposed group by 1),
        last as (select arg_max(trend, date) as level, max(date) as last_date from decomposed)
        select cast(last_date + h as date) as date, round(level + coalesce(e, 0e0), 2) as forecast_trend_seasonal
        from last cross join (select unnest(generate_series(1, 548))::integer as h)
        left join effect on doy = dayofyear(cast(last_date + h as date))""",
)
def y07_detrended(t):
    out = y.ensemble_forecast(daily_sales(t), DAYS, level="trend").select("date", "forecast_trend_seasonal")
    return rounded(out, {"forecast_trend_seasonal": 2})


_PROFILE = """scaled as (select month(date) as month, day(date) as day, year(date) as year, date,
    revenue / nullif(cast(sum(cast(revenue as decimal(18,4))) over w as double) / count(*) over w, 0) as r,
    cogs / nullif(cast(sum(cast(cogs as decimal(18,4))) over w as double) / count(*) over w, 0) as c
    from v_daily window w as (partition by year(date)))"""


@query(
    "Y09_seasonal_profile",
    f"""with {_PROFILE} select cast(month as integer) as month, cast(day as integer) as day, round(avg(r), 9) as revenue_norm,
        round(avg(c), 9) as cogs_norm from scaled group by 1, 2""",
)
def y09(t):
    out = y.seasonal_profile(daily_sales(t), ["revenue", "cogs"])
    return rounded(out, {"revenue_norm": 9, "cogs_norm": 9})


_ANNUAL = """annual as (select year, revenue, cogs, is_full, (revenue - pr) / nullif(pr, 0) as revenue_yoy, (cogs - pc) / nullif(pc, 0) as cogs_yoy
    from (select *, lag(revenue) over (order by year) as pr, lag(cogs) over (order by year) as pc from
    (select cast(year(date) as integer) as year, cast(sum(cast(revenue as decimal(18,4))) as double) as revenue,
     cast(sum(cast(cogs as decimal(18,4))) as double) as cogs, count(distinct date) >= 365 as is_full from v_daily group by 1))),
    factors as (select max(year) as base_year, count(*) as full_years,
    pow(arg_max(revenue, year) / arg_min(revenue, year), 1e0 / (count(*) - 1)) as revenue_growth, arg_max(revenue, year) / 365e0 as revenue_base,
    pow(arg_max(cogs, year) / arg_min(cogs, year), 1e0 / (count(*) - 1)) as cogs_growth, arg_max(cogs, year) / 365e0 as cogs_base
    from annual where is_full)"""


@query("Y10_annual_totals", f"with {_ANNUAL} select * from annual")
def y10(t):
    return y.annual_totals(daily_sales(t), ["revenue", "cogs"])


@query(
    "Y10_growth_factors",
    f"""with {_ANNUAL} select base_year, full_years, round(revenue_growth, 9) as revenue_growth, revenue_base,
        round(cogs_growth, 9) as cogs_growth, cogs_base from factors""",
)
def y10_growth(t):
    out = y.growth(y.annual_totals(daily_sales(t), ["revenue", "cogs"]), ["revenue", "cogs"])
    return rounded(out, {"revenue_growth": 9, "cogs_growth": 9})


@query(
    "Y11_growth_profile_forecast",
    f"""with {_PROFILE}, {_ANNUAL}, profile as (select month, day, avg(r) as r, avg(c) as c from scaled group by 1, 2),
        days as (select cast(hi + h as date) as date from (select max(date) as hi from v_daily),
        (select unnest(generate_series(1, 548))::integer as h))
        select date, round(revenue_base * pow(revenue_growth, year(date) - base_year) * coalesce(r, 1e0), 2) as revenue_pred,
        round(cogs_base * pow(cogs_growth, year(date) - base_year) * coalesce(c, 1e0), 2) as cogs_pred
        from days cross join factors left join profile on month = month(date) and day = day(date)""",
)
def y11(t):
    return rounded(y.growth_profile_forecast(daily_sales(t), DAYS), {"revenue_pred": 2, "cogs_pred": 2})


# Scenarios -------------------------------------------------------------------------------------


def _scenario_sql(name: str) -> str:
    factors, quarters = sc.SCENARIOS[name]
    value = "forecast_ensemble" + "".join(f" * {x}e0" for x in factors)
    if quarters:
        return f"case when quarter(date) in {quarters} then {value} else forecast_ensemble end"
    return value


_SCENARIOS = f"{_TRAIN}, scenarios as (" + " union all ".join(
    f"select date, '{n}' as scenario, {_scenario_sql(n)} as value from ensemble" for n in sc.SCENARIOS
) + """), totals as (select scenario, sum(value) as total from scenarios group by 1),
    ranked as (select scenario, total, base_total, total - base_total as impact, (total - base_total) * 100 / nullif(base_total, 0) as impact_pct
    from totals cross join (select total as base_total from totals where scenario = 'base'))"""


@query(
    "Y12_scenarios_wide",
    f"with {_TRAIN} select date, "
    + ", ".join(f"round({_scenario_sql(n)} + 1e-7, 4) as scenario_{n}" for n in sc.SCENARIOS)
    + " from ensemble",
)
def y12(t):
    return rounded(sc.scenario_wide(_forecast(t)), {f"scenario_{n}": 4 for n in sc.SCENARIOS}, nudge=1e-7)


@query("Y12_scenarios_long", f"with {_SCENARIOS} select date, scenario, round(value + 1e-7, 4) as value from scenarios")
def y12_long(t):
    return rounded(sc.scenario_long(_forecast(t)), {"value": 4}, nudge=1e-7)


@query(
    "Y13_scenario_totals",
    f"""with {_SCENARIOS} select scenario, round(total, 2) as total, round(base_total, 2) as base_total, round(impact, 2) as impact,
        round(impact_pct, 6) as impact_pct, cast(dense_rank() over (order by round(impact, 2) desc) as integer) as impact_rank from ranked""",
)
def y13(t):
    out = sc.scenario_totals(sc.scenario_long(_forecast(t)))
    return rounded(out, {"total": 2, "base_total": 2, "impact": 2, "impact_pct": 6})


_ACTIONS = f"""{_SCENARIOS}, actions(action, kind, scenario, effort, months, priority, cost_rate) as (values """ + ", ".join(
    f"('{a['action']}', '{a['kind']}', '{a['scenario']}', '{a['effort']}', cast({a['months']} as integer), '{a['priority']}', {a['cost_rate']}e0)"
    for a in sc.ACTIONS
) + """), returns as (select action, kind, scenario, effort, months, priority, impact as revenue_impact,
    cost_rate * base_total as estimated_cost, case when cost_rate * base_total > 0
    then (impact - cost_rate * base_total) / (cost_rate * base_total) * 100 else 0e0 end as roi_percent
    from actions join ranked using (scenario))"""


@query(
    "Y14_action_returns",
    f"""with {_ACTIONS} select * replace (round(revenue_impact, 2) as revenue_impact, round(estimated_cost, 2) as estimated_cost,
        round(roi_percent, 6) as roi_percent) from returns""",
)
def y14(t):
    out = sc.action_returns(sc.scenario_totals(sc.scenario_long(_forecast(t))))
    return rounded(out, {"revenue_impact": 2, "estimated_cost": 2, "roi_percent": 6})


_SPREAD = f"""{_TRAIN}, spread as (select date, forecast_ensemble, sqrt((pow(forecast_drift - forecast_ensemble, 2)
    + pow(forecast_seasonal_naive - forecast_ensemble, 2) + pow(forecast_trend_seasonal - forecast_ensemble, 2)) / 2e0) as std_dev from ensemble)"""


@query(
    "Y15_method_spread",
    f"""with {_SPREAD} select date, round(forecast_ensemble + 1e-7, 4) as forecast_ensemble, round(std_dev, 3) as std_dev,
        round(std_dev / nullif(forecast_ensemble, 0), 9) as cv from spread""",
)
def y15(t):
    out = rounded(sc.method_spread(_forecast(t)), {"std_dev": 3, "cv": 9})
    return rounded(out, {"forecast_ensemble": 4}, nudge=1e-7)


@query(
    "Y15_method_agreement",
    f"""with {_SPREAD} select round(m, 9) as mean_cv, case when m < 0.1 then 'high' when m < 0.2 then 'moderate' else 'divergent' end
        as agreement from (select avg(std_dev / nullif(forecast_ensemble, 0)) as m from spread)""",
)
def y15_mean(t):
    return rounded(sc.method_agreement(sc.method_spread(_forecast(t))), {"mean_cv": 9})


@query(
    "Y16_monthly_projection",
    f"with {_TRAIN} select strftime(date, '%Y-%m') as month, round(sum(forecast_ensemble), 2) as total from ensemble group by 1",
)
def y16(t):
    return rounded(sc.monthly_projection(_forecast(t)), {"total": 2})


@query(
    "Y16_horizon_total",
    f"""with {_TRAIN} select round(sum(forecast_ensemble), 2) as total, count(*) as days,
        round(sum(forecast_ensemble) / count(*), 4) as mean_per_day from ensemble""",
)
def y16_total(t):
    return rounded(sc.horizon_total(_forecast(t)), {"total": 2, "mean_per_day": 4})


@query(
    "Y17_phase_roll_up",
    f"""with {_ACTIONS} select case when action in ('R2', 'R5') then 'Phase 1' when action in ('R1', 'R4') then 'Phase 2'
        else 'Phase 3' end as phase, count(*) as actions, round(sum(revenue_impact), 2) as revenue_impact,
        round(sum(estimated_cost), 2) as estimated_cost,
        round((sum(revenue_impact) - sum(estimated_cost)) * 100 / nullif(sum(estimated_cost), 0), 6) as roi_percent
        from returns group by 1""",
)
def y17(t):
    returns = sc.action_returns(sc.scenario_totals(sc.scenario_long(_forecast(t))))
    return rounded(sc.phase_roll_up(returns), {"revenue_impact": 2, "estimated_cost": 2, "roi_percent": 6})


@query(
    "Y18_explained_share",
    f"with {_SHARES} select round(sum(pct_total), 9) as explained from shares where component <> 'residual'",
)
def y18(t):
    return rounded(y.explained_share(y.variance_shares(y.decompose(daily_sales(t)))), {"explained": 9})


@query(
    "Y18_forecast_summary",
    f"with {_TRAIN} "
    + " union all ".join(
        f"""select '{c}' as metric, count({c}) as count, round(avg({c}), 3) as mean, round(stddev_samp({c}), 3) as std,
        round(min({c}), 3) as min, round(quantile_cont({c}, 0.25), 3) as q25, round(median({c}), 3) as q50,
        round(quantile_cont({c}, 0.75), 3) as q75, round(max({c}), 3) as max from ensemble"""
        for c in _FORECASTS
    ),
)
def y18_summary(t):
    out = r.numeric_summary(_forecast(t), _FORECASTS)
    return rounded(out, {c: 3 for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})


# Folds, seasonal naive, backtest ---------------------------------------------------------------

_FOLDS = """folds as (select cast(k as integer) as fold_id, hi - cast((3 - k) * 120 + 120 as integer) as train_end,
    hi - cast((3 - k) * 120 + 119 as integer) as valid_start, hi - cast((3 - k) * 120 as integer) as valid_end
    from (select max(date) as hi from v_daily), (select unnest(range(1, 4)) as k))"""


def _naive_sql(source: str, comma: str, on: str, season: int, value: str, days: int) -> str:
    """Seasonal naive after the last day, read from the last season by date."""
    return f"""select {comma}cast(hi + h as date) as date, h as step, b.{value} as predicted
        from (select max(date) as hi from {source}) cross join (select unnest(generate_series(1, {days}))::integer as h)
        join {source} b on b.date = hi - {season} + 1 + cast((h - 1) % {season} as integer) {on}"""


def _backtest(source: str, keys: str) -> str:
    comma = f"a.{keys}, " if keys else ""
    same = f"and b.{keys} = a.{keys}" if keys else ""
    return f"{_FOLDS}, predictions as (" + " union all ".join(
        f"""select f.fold_id, {comma}a.date, '{name}' as model, a.revenue as actual, b.revenue as predicted
        from folds f join {source} a on a.date between f.valid_start and f.valid_end
        join {source} b on b.date = f.train_end - {season} + 1 + cast((a.date - f.train_end - 1) % {season} as integer) {same}"""
        for name, season in b.NAIVE_SEASONS.items()
    ) + ")"


def _metrics_sql(by: str, source: str = "predictions", actual: str = "actual", predicted: str = "predicted") -> str:
    return f"""select {by}, avg(abs({actual} - {predicted})) as mae, sqrt(avg(({actual} - {predicted}) * ({actual} - {predicted}))) as rmse,
        1e0 - sum(({actual} - {predicted}) * ({actual} - {predicted})) / nullif(sum(({actual} - m) * ({actual} - m)), 0) as r2
        from (select *, avg({actual}) over (partition by {by}) as m from {source}) group by all"""


_METRIC_DIGITS = {"mae": 4, "rmse": 4, "r2": 9}
_ROUND_METRICS = "round(mae, 4) as mae, round(rmse, 4) as rmse, round(r2, 9) as r2"


@query("F01_fold_bounds", f"with {_FOLDS} select * from folds")
def f01(t):
    return f.build_folds(daily_sales(t))


@query("F02_weekly_naive", _naive_sql("v_daily", "", "", 7, "revenue", DAYS))
def f02(t):
    return f.seasonal_naive(daily_sales(t), DAYS, 7)


@query("F03_yearly_naive", _naive_sql("v_dense", "b.series, ", "", 365, "revenue", DAYS))
def f03(t):
    return f.seasonal_naive(panel_sales(t), DAYS, 365, "revenue", KEYS)


_PAIR = f"""w as ({_naive_sql("v_daily", "", "", 7, "revenue", DAYS)}), y as ({_naive_sql("v_daily", "", "", 365, "revenue", DAYS)}),
    wc as ({_naive_sql("v_daily", "", "", 7, "cogs", DAYS)}), yc as ({_naive_sql("v_daily", "", "", 365, "cogs", DAYS)})"""


def _pair(t):
    daily = daily_sales(t)
    return f.align(
        {
            "revenue_raw": f.seasonal_naive(daily, DAYS, 7),
            "revenue_seasonal": f.seasonal_naive(daily, DAYS, 365),
            "cogs_raw": f.seasonal_naive(daily, DAYS, 7, "cogs"),
            "cogs_seasonal": f.seasonal_naive(daily, DAYS, 365, "cogs"),
        }
    )


@query(
    "F08_blend_of_naives",
    f"with {_PAIR} select w.date, round(0.9e0 * w.predicted + (1e0 - 0.9e0) * y.predicted + 1e-7, 4) as predicted from w join y using (date)",
)
def f08(t):
    out = _pair(t).select("date", f.blend("revenue_raw", "revenue_seasonal", 0.9).alias("predicted"))
    return rounded(out, {"predicted": 4}, nudge=1e-7)


@query(
    "F11_post_processing",
    f"""with {_PAIR} select date, round(greatest(w.predicted, 0e0), 4) as revenue,
        round(least(greatest(yc.predicted, 0e0), greatest(w.predicted, 0e0) * 0.999e0) + 1e-7, 4) as cogs
        from w join yc using (date)""",
)
def f11(t):
    out = f.post_process(
        _pair(t).select("date", F.col("revenue_raw").alias("revenue"), F.col("cogs_seasonal").alias("cogs")), "revenue", "cogs"
    )
    return rounded(rounded(out, {"revenue": 4}), {"cogs": 4}, nudge=1e-7)


@query(
    "F13_forecast_detail",
    f"""with {_PAIR} select date, w.predicted as forecast_week, y.predicted as forecast_year, 'year' as selected_model,
        greatest(y.predicted, 0e0) as forecast_selected from w join y using (date)""",
)
def f13(t):
    daily = daily_sales(t)
    wide = f.align({"week": f.seasonal_naive(daily, DAYS, 7), "year": f.seasonal_naive(daily, DAYS, 365)})
    return f.forecast_detail(wide, ["week", "year"], "year")


_TOTAL_BACKTEST = _backtest("v_daily", "")
_PANEL_BACKTEST = _backtest("v_dense", "series")


@query("B01_naive_backtest", f"with {_PANEL_BACKTEST} select * from predictions")
def b01(t):
    return b.naive_backtest(panel_sales(t), "revenue", KEYS)


@query(
    "B02_fold_metrics",
    f"with {_PANEL_BACKTEST}, m as ({_metrics_sql('fold_id, series, model')}) select fold_id, series, model, {_ROUND_METRICS} from m",
)
def b02(t):
    return rounded(b.metrics(b.naive_backtest(panel_sales(t), "revenue", KEYS), ["fold_id", "series", "model"]), _METRIC_DIGITS)


@query(
    "B03_error_metrics",
    f"with {_TOTAL_BACKTEST}, m as ({_metrics_sql('fold_id, model')}) select fold_id, model, {_ROUND_METRICS} from m",
)
def b03(t):
    return rounded(b.metrics(b.naive_backtest(daily_sales(t)), ["fold_id", "model"]), _METRIC_DIGITS)


_RANKED = """means as (select model, avg(mae) as mae, avg(rmse) as rmse, avg(r2) as r2 from m group by 1),
    ranked as (select *, cast(dense_rank() over (order by rmse) as integer) as rank_rmse,
    cast(dense_rank() over (order by mae) as integer) as rank_mae, cast(dense_rank() over (order by r2 desc nulls last) as integer) as rank_r2 from means),
    summary as (select *, (rank_rmse + rank_mae + rank_r2) / 3e0 as composite_rank from ranked)"""
_SUMMARY = f"""{_TOTAL_BACKTEST}, m as ({_metrics_sql('fold_id, model')}), {_RANKED}"""


@query("B04_model_summary", f"with {_SUMMARY} select * replace ({_ROUND_METRICS}) from summary")
def b04(t):
    summary = b.model_summary(b.metrics(b.naive_backtest(daily_sales(t)), ["fold_id", "model"]))
    return rounded(summary, _METRIC_DIGITS)


@query(
    "B05_mape",
    f"""with {_PROFILE}, {_ANNUAL}, profile as (select month, day, avg(r) as r, avg(c) as c from scaled
        where year <= (select base_year - 2 from factors) group by 1, 2)
        select round(avg(abs(revenue - rp) / nullif(abs(revenue), 0)) * 100, 6) as revenue_mape,
        round(avg(abs(cogs - cp) / nullif(abs(cogs), 0)) * 100, 6) as cogs_mape from (
        select d.revenue, d.cogs, revenue_base * pow(revenue_growth, year(date) - base_year) * coalesce(r, 1e0) as rp,
        cogs_base * pow(cogs_growth, year(date) - base_year) * coalesce(c, 1e0) as cp
        from v_daily d cross join factors left join profile on month = month(date) and day = day(date)
        where year(date) > base_year - 2 and year(date) <= base_year)""",
)
def b05(t):
    judged = y.growth_profile_validation(daily_sales(t))
    out = judged.agg(
        b.mape("revenue", "revenue_pred").alias("revenue_mape"), b.mape("cogs", "cogs_pred").alias("cogs_mape")
    )
    return rounded(out, {"revenue_mape": 6, "cogs_mape": 6})


@query(
    "B06_best_model",
    f"with {_SUMMARY} select model, {_ROUND_METRICS} from (select * from summary order by composite_rank, rmse, mae, model limit 1)",
)
def b06(t):
    summary = b.model_summary(b.metrics(b.naive_backtest(daily_sales(t)), ["fold_id", "model"]))
    return rounded(b.best_model(summary), _METRIC_DIGITS)


@query(
    "B07_blend_candidates",
    f"""with {_PANEL_BACKTEST}, wide as (select fold_id, series, date, actual,
        max(predicted) filter (where model = 'seasonal_week_lag7') as w, max(predicted) filter (where model = 'seasonal_year_lag365') as s
        from predictions group by 1, 2, 3, 4),
        blends as (select fold_id, series, actual, a, printf('blend_alpha_%.2f', a) as model, a * w + (1e0 - a) * s as predicted
        from wide cross join (values (0.75e0), (0.9e0)) k(a)), m as ({_metrics_sql('model, fold_id, series', 'blends')})
        select model, fold_id, series, {_ROUND_METRICS} from m""",
)
def b07(t):
    predictions = b.naive_backtest(panel_sales(t), "revenue", KEYS)
    blends = b.blend_predictions(
        predictions, "seasonal_week_lag7", "seasonal_year_lag365", f.BLEND_ALPHAS, ["fold_id", "series"]
    )
    return rounded(b.metrics(blends, ["model", "fold_id", "series"]), _METRIC_DIGITS)


_HOLDOUT = """cut as (select max(date) - 180 as te from v_daily),
    held as (select a.date, a.revenue, a.cogs, w.revenue as wr, w.cogs as wc, s.revenue as sr, s.cogs as sc from cut
    join v_daily a on a.date > te
    join v_daily w on w.date = te - 7 + 1 + cast((a.date - te - 1) % 7 as integer)
    join v_daily s on s.date = te - 365 + 1 + cast((a.date - te - 1) % 365 as integer)),
    blends as (select alpha, revenue, cogs, alpha * wr + (1e0 - alpha) * sr as rp, alpha * wc + (1e0 - alpha) * sc as cp
    from held cross join (values (0.6e0), (0.7e0), (0.8e0), (0.9e0)) k(alpha))"""


@query(
    "B08_blend_weights",
    f"""with {_HOLDOUT}, r as ({_metrics_sql('alpha', 'blends', 'revenue', 'rp')}), c as ({_metrics_sql('alpha', 'blends', 'cogs', 'cp')})
        select alpha, round(r.mae, 4) as rev_mae, round(r.rmse, 4) as rev_rmse, round(r.r2, 9) as rev_r2,
        round(c.mae, 4) as cogs_mae, round(c.rmse, 4) as cogs_rmse, round(c.r2, 9) as cogs_r2,
        round((r.mae + c.mae) / 2e0, 4) as avg_mae from r join c using (alpha)""",
)
def b08(t):
    train, held = b.tail_split(daily_sales(t), 180)
    forecasts = f.align(
        {
            "revenue_raw": f.seasonal_naive(train, 180, 7),
            "revenue_seasonal": f.seasonal_naive(train, 180, 365),
            "cogs_raw": f.seasonal_naive(train, 180, 7, "cogs"),
            "cogs_seasonal": f.seasonal_naive(train, 180, 365, "cogs"),
        }
    )
    table = b.blend_weights(held.join(forecasts, "date"), f.DUAL_ALPHAS)
    digits = {f"{p}_{m}": d for p in ("rev", "cogs") for m, d in _METRIC_DIGITS.items()}
    return rounded(table, {**digits, "avg_mae": 4})


@query(
    "B09_ranked_predictions",
    f"""with {_SUMMARY} select p.*, composite_rank from predictions p left join summary using (model)""",
)
def b09(t):
    predictions = b.naive_backtest(daily_sales(t))
    summary = b.model_summary(b.metrics(predictions, ["fold_id", "model"]))
    return b.rank_on_predictions(predictions, summary)
