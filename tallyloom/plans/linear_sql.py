"""SQL of the linear models: co-moments by aggregates, elimination and rollout by recursion.

One query text per step, put together from the same pieces:

* ``design``: the supervised rows; fold 4 stands for all of them;
* ``solved``: Gauss-Jordan elimination on the correlations of 15 features, one column a step;
* ``rolled``: the days ahead, each one a step with the last year of a series as a list.
"""

from __future__ import annotations

from tallyloom.operators import features as e
from tallyloom.operators.forecast import HORIZON, N_FOLDS

_N = len(e.BASELINE_FEATURES)
_CAL = {
    "dow": "isodow({d}) - 1", "month": "month({d})", "day": "day({d})", "day_of_year": "dayofyear({d})",
    "sin_doy_1": "sin(2 * pi() * dayofyear({d}) / 365.25e0)", "cos_doy_1": "cos(2 * pi() * dayofyear({d}) / 365.25e0)",
}


def _design(source: str, keys: str) -> str:
    by = f"partition by {keys} " if keys else ""
    comma = f"{keys}, " if keys else ""
    columns = {name: _CAL[name].format(d="date") for name in e.BASIC_CALENDAR}
    columns["trend_idx"] = f"row_number() over ({by}order by date) - 1"
    columns |= {f"lag_{k}": f"lag(revenue, {k}) over ({by}order by date)" for k in e.BASE_LAGS}
    columns |= {
        f"roll_mean_{w}": f"avg(revenue) over ({by}order by date rows between {w} preceding and 1 preceding)" for w in e.BASE_MEANS
    }
    return f"""design as (select * from (select {comma}date, revenue, {', '.join(f'cast({x} as double) as {n}' for n, x in columns.items())}
        from {source}) where trend_idx >= {e.MAX_LAG})"""


def _solved() -> str:
    names = [*e.BASELINE_FEATURES, "revenue"]
    width = len(names)
    products = ", ".join(f"covar_pop({a}, {b})" for a in names for b in names)
    spread = "sqrt(c[({0}) * " + str(width + 1) + " + 1])"
    i, j = f"(idx // {width})", f"(idx % {width})"
    return f"""moments as (
        select fold, [{', '.join(f'avg({n})' for n in names)}] as mean, [{products}] as c
        from design, (select max(date) as hi from design), (select unnest(range(1, {N_FOLDS + 2})) as fold)
        where fold = {N_FOLDS + 1} or date_diff('day', date, hi) >= ({N_FOLDS + 1} - fold) * {HORIZON} group by fold),
    elimination as (
        select fold, 0 as k, [case when {j} < {_N} then c[idx + 1] / {spread.format(i)} / {spread.format(j)}
            else c[idx + 1] / {spread.format(i)} end for idx in range({_N * width})] as m from moments
        union all
        select fold, k + 1, [case when {i} = k then m[idx + 1] / m[k * {width + 1} + 1]
            else m[idx + 1] - m[{i} * {width} + k + 1] * m[k * {width} + {j} + 1] / m[k * {width + 1} + 1] end
            for idx in range({_N * width})] from elimination where k < {_N}),
    slopes as (
        select fold, mean, [m[i * {width} + {width}] / {spread.format('i')} for i in range({_N})] as beta
        from elimination join moments using (fold) where k = {_N}),
    solved as (select fold, beta, mean[{width}] - list_sum([beta[i] * mean[i] for i in range(1, {_N + 1})]) as intercept from slopes)"""


def _rolled(source: str, keys: str, days: int, folds: str) -> str:
    """Days ahead for the models of the given folds; each starts where its training ends."""
    comma = f"{keys}, " if keys else ""
    day = "cast(last + k + 1 as date)"
    terms = {name: _CAL[name].format(d=day) for name in e.BASIC_CALENDAR}
    terms["trend_idx"] = "n + k"
    terms |= {f"lag_{k}": f"h[{e.MAX_LAG + 1 - k}]" for k in e.BASE_LAGS}
    terms |= {f"roll_mean_{w}": f"list_avg(h[{e.MAX_LAG + 1 - w}:])" for w in e.BASE_MEANS}
    value = " + ".join([f"beta[{i}] * ({terms[n]})" for i, n in enumerate(e.BASELINE_FEATURES, start=1)] + ["intercept"])
    return f"""starts as (
        select fold, {comma}max(date) as last, count(*) as n, list(revenue order by date)[-{e.MAX_LAG}:] as h
        from {source}, (select max(date) as hi from {source}), (select unnest({folds}) as fold)
        where fold = {N_FOLDS + 1} or date_diff('day', date, hi) >= ({N_FOLDS + 1} - fold) * {HORIZON} group by all),
    rollout as (
        select fold, {comma}last, n, 0 as k, h, cast(null as double) as predicted, beta, intercept from starts join solved using (fold)
        union all
        select fold, {comma}last, n, k + 1, h[2:] || [predicted], predicted, beta, intercept from (
            select fold, {comma}last, n, k, h, beta, intercept, greatest({value}, 0e0) as predicted from rollout where k < {days})),
    rolled as (select fold, {comma}cast(last + k as date) as date, predicted from rollout where k > 0)"""


COEFFICIENTS = f"""with recursive {_design('v_daily', '')}, {_solved()}
    select feature, case when regexp_matches(feature, '^(lag|roll)_') then round(coefficient, 6) else round(coefficient, 0) end + 0e0 as coefficient from (
        select unnest([{', '.join(f"'{n}'" for n in e.BASELINE_FEATURES)}, 'intercept']) as feature,
            unnest(list_append(beta, intercept)) as coefficient from solved where fold = {N_FOLDS + 1})"""


def rollout_text(days: int) -> str:
    """Common tables up to ``rolled`` for every series of the panel, with the model of all rows."""
    return f"with recursive {_design('v_dense', 'series')}, {_solved()}, {_rolled('v_dense', 'series', days, f'[{N_FOLDS + 1}]')}"


def backtest_text() -> str:
    """Common tables up to ``rolled`` for the folds of the total series."""
    return f"with recursive {_design('v_daily', '')}, {_solved()}, {_rolled('v_daily', '', HORIZON, f'range(1, {N_FOLDS + 1})')}"
