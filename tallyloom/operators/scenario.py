"""Scenarios over a forecast: expansion, totals, return on actions, agreement of methods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.expr import month_text, ratio
from tallyloom.functions.series import series_window
from tallyloom.operators.relational import row_spread

# Scenario multipliers; a scenario with quarters applies in those quarters only.
PROMO_QUARTERS = (1, 3, 4)
SCENARIOS: dict[str, tuple[tuple[float, ...], tuple[int, ...]]] = {
    "base": ((), ()),
    "promotional_boost": ((1.10,), PROMO_QUARTERS),
    "channel_optimization": ((1.05,), ()),
    "traffic_increase": ((1.03,), ()),
    "inventory_optimization": ((1.08,), ()),
    "product_mix_shift": ((1.12,), ()),
    "return_reduction": ((1.02,), ()),
    "conservative": ((1.10,), PROMO_QUARTERS),
    "moderate": ((1.10, 1.05, 1.02), ()),
    "aggressive": ((1.10, 1.05, 1.08, 1.12), ()),
}

# Actions, the scenario each one brings about, and its cost as a share of base revenue.
ACTIONS = [
    {"action": "R1", "kind": "Tactical", "scenario": "promotional_boost", "effort": "Medium", "months": 3, "priority": "High", "cost_rate": 0.08},
    {"action": "R2", "kind": "Tactical", "scenario": "channel_optimization", "effort": "Low", "months": 1, "priority": "High", "cost_rate": 0.02},
    {"action": "R3", "kind": "Strategic", "scenario": "inventory_optimization", "effort": "High", "months": 6, "priority": "Critical", "cost_rate": 0.05},
    {"action": "R4", "kind": "Strategic", "scenario": "product_mix_shift", "effort": "Medium", "months": 4, "priority": "High", "cost_rate": 0.03},
    {"action": "R5", "kind": "Tactical", "scenario": "return_reduction", "effort": "Low", "months": 2, "priority": "High", "cost_rate": 0.01},
]

# The phase in which each action is carried out.
PHASES = {"R2": "Phase 1", "R5": "Phase 1", "R1": "Phase 2", "R4": "Phase 2", "R3": "Phase 3"}


def literal_rows(rows: Sequence[Mapping]) -> Column:
    """A small parameter table as an array of structs, to be unfolded on the rows that need it."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows])


def attach_parameters(df: DataFrame, rows: Sequence[Mapping]) -> DataFrame:
    """Each row once per parameter row."""
    return df.select("*", F.inline(literal_rows(rows)))


def _scenario_value(value: Column, factors: tuple[float, ...], quarters: tuple[int, ...], date: str) -> Column:
    out = value
    for f in factors:
        out = out * F.lit(f)
    return F.when(F.quarter(date).isin(*quarters), out).otherwise(value) if quarters else out


def scenario_wide(forecast: DataFrame, value: str = "forecast_ensemble", keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """One column per scenario."""
    cols = [
        _scenario_value(F.col(value), factors, quarters, date).alias(f"scenario_{name}")
        for name, (factors, quarters) in SCENARIOS.items()
    ]
    return forecast.select(*keys, date, *cols)


def scenario_long(forecast: DataFrame, value: str = "forecast_ensemble", keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """One row per day and scenario."""
    lines = F.array(
        *[
            F.struct(F.lit(name).alias("scenario"), _scenario_value(F.col(value), factors, quarters, date).alias("value"))
            for name, (factors, quarters) in SCENARIOS.items()
        ]
    )
    return forecast.select(*keys, date, F.inline(lines))


def scenario_totals(scenarios: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total per scenario, impact against the base, and rank by impact."""
    keys = list(keys)
    totals = scenarios.groupBy(*keys, "scenario").agg(F.sum("value").alias("total"))
    w = series_window(keys)
    base = F.max(F.when(F.col("scenario") == "base", F.col("total"))).over(w)
    out = totals.withColumn("base_total", base).withColumn("impact", F.col("total") - F.col("base_total"))
    return out.withColumn("impact_pct", ratio(F.col("impact") * 100, "base_total")).withColumn(
        "impact_rank", F.dense_rank().over(w.orderBy(F.round("impact", 2).desc()))
    )


def action_returns(totals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Impact, cost and return on cost of each action; zero where an action costs nothing."""
    keys = list(keys)
    by_scenario = F.map_from_entries(
        F.array(
            *[
                F.struct(F.lit(a["scenario"]), F.struct(*[F.lit(v).alias(k) for k, v in a.items() if k != "scenario"]))
                for a in ACTIONS
            ]
        )
    )
    matched = totals.withColumn("_p", F.try_element_at(by_scenario, F.col("scenario"))).filter(F.col("_p").isNotNull())
    cost = F.col("_p.cost_rate") * F.col("base_total")
    roi = F.when(cost > 0, (F.col("impact") - cost) / F.nullif(cost, F.lit(0.0)) * 100).otherwise(F.lit(0.0))
    return matched.select(
        *keys,
        F.col("_p.action").alias("action"),
        F.col("_p.kind").alias("kind"),
        "scenario",
        F.col("_p.effort").alias("effort"),
        F.col("_p.months").alias("months"),
        F.col("_p.priority").alias("priority"),
        F.col("impact").alias("revenue_impact"),
        cost.alias("estimated_cost"),
        roi.alias("roi_percent"),
    )


def phase_roll_up(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Actions by phase: how many, their impact and cost, and the return of the phase."""
    phase = None
    for action, name in PHASES.items():
        phase = F.when(F.col("action") == action, name) if phase is None else phase.when(F.col("action") == action, name)
    out = returns.withColumn("phase", phase).groupBy(*keys, "phase").agg(
        F.count(F.lit(1)).alias("actions"),
        F.sum("revenue_impact").alias("revenue_impact"),
        F.sum("estimated_cost").alias("estimated_cost"),
    )
    return out.withColumn("roi_percent", ratio((F.col("revenue_impact") - F.col("estimated_cost")) * 100, "estimated_cost"))


METHODS = ("forecast_drift", "forecast_seasonal_naive", "forecast_trend_seasonal")


def method_spread(forecast: DataFrame, keys: Sequence[str] = (), methods: Sequence[str] = METHODS) -> DataFrame:
    """Standard deviation across methods per day, and relative to the ensemble."""
    _, std = row_spread(methods)
    out = forecast.select(*keys, "date", "forecast_ensemble", std.alias("std_dev"))
    return out.withColumn("cv", ratio("std_dev", "forecast_ensemble"))


def method_agreement(spread: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean relative spread and the band it falls in."""
    cv = F.col("mean_cv")
    return spread.groupBy(*keys).agg(F.avg("cv").alias("mean_cv")).withColumn(
        "agreement", F.when(cv < 0.1, "high").when(cv < 0.2, "moderate").otherwise("divergent")
    )


def monthly_projection(forecast: DataFrame, value: str = "forecast_ensemble", keys: Sequence[str] = ()) -> DataFrame:
    return forecast.groupBy(*keys, month_text("date").alias("month")).agg(F.sum(value).alias("total"))


def horizon_total(forecast: DataFrame, value: str = "forecast_ensemble", keys: Sequence[str] = ()) -> DataFrame:
    """Total over the horizon and mean per day."""
    return forecast.groupBy(*keys).agg(
        F.sum(value).alias("total"), F.count(F.lit(1)).alias("days"), ratio(F.sum(value), F.count(F.lit(1))).alias("mean_per_day")
    )
