"""Trend, seasonality and simple closed-form forecasts of many daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.expr import money, money_sum, ratio
from tallyloom.functions.series import centred, row_position, series_window

TREND_ROWS = 365
DAYS_PER_YEAR = 365


def trend(df: DataFrame, value: str = "revenue", keys: Sequence[str] = (), rows: int = TREND_ROWS) -> DataFrame:
    """Centred moving average; the ends of a series, where it is not full, take the series' line."""
    w = series_window(keys)
    out = df.withColumn("step", row_position(keys).cast("double"))
    line = F.regr_intercept(value, "step").over(w) + F.regr_slope(value, "step").over(w) * F.col("step")
    average = centred(F.sum(money(value)), value, rows, keys).cast("double") / F.lit(float(rows))
    return out.withColumn("trend", F.coalesce(average, line))


def decompose(df: DataFrame, value: str = "revenue", keys: Sequence[str] = (), rows: int = TREND_ROWS) -> DataFrame:
    """Trend, day-of-year seasonality, what is left of it, and a residual that is zero by construction."""
    out = trend(df, value, keys, rows).withColumn("detrended", F.col(value) - F.col("trend"))
    # One (series, day of year) group holds one row per year.
    seasonal = F.percentile("detrended", F.lit(0.5)).over(W.partitionBy(*keys, F.dayofyear("date")))
    out = out.withColumn("seasonality", seasonal)
    out = out.withColumn("promotional", F.col("detrended") - F.col("seasonality"))
    total = F.col("trend") + F.col("seasonality") + F.col("promotional")
    return out.withColumn("residual", F.col(value) - total).drop("step")


COMPONENTS = ("trend", "seasonality", "promotional", "residual")


def variance_shares(decomposed: DataFrame, value: str = "revenue", keys: Sequence[str] = ()) -> DataFrame:
    """Sample variance of each component and its share of the variance of the series."""
    row = decomposed.groupBy(*keys).agg(
        F.var_samp(value).alias("_total"), *[F.var_samp(c).alias(f"_{c}") for c in COMPONENTS]
    )
    share = lambda c: F.coalesce(ratio(f"_{c}", "_total"), F.lit(0.0))
    lines = F.array(
        *[
            F.struct(F.lit(c).alias("component"), F.col(f"_{c}").alias("variance"), share(c).alias("pct_total"))
            for c in COMPONENTS
        ]
    )
    return row.select(*keys, F.inline(lines))


def explained_share(shares: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of the shares without the residual."""
    return shares.filter(F.col("component") != "residual").groupBy(*keys).agg(F.sum("pct_total").alias("explained"))


# Horizon ---------------------------------------------------------------------------------------


def horizon_of(last_date: str, days: int) -> Column:
    """(step from 0, date) of the days after a date, to be unfolded on the row that holds it."""
    return F.posexplode(F.sequence(F.date_add(last_date, 1), F.date_add(last_date, days)))


def unfold_horizon(per_series: DataFrame, days: int, last_date: str = "last_date") -> DataFrame:
    """Repeat each series row for every day of the horizon; ``step`` counts from 1."""
    kept = [c for c in per_series.columns if c != last_date]
    out = per_series.select(*kept, horizon_of(last_date, days).alias("_pos", "date"))
    return out.withColumn("step", F.col("_pos") + 1).drop("_pos")


# Simple forecasts ------------------------------------------------------------------------------


def ensemble_forecast(
    train: DataFrame, days: int, value: str = "revenue", keys: Sequence[str] = (), level: str = "mean"
) -> DataFrame:
    """Drift, day-of-year median, level plus day-of-year median, and their equal-weight mean.

    ``level="mean"`` adds the median of the values to the mean of the series, which counts the
    level twice; ``level="trend"`` adds the median of the *detrended* values to the last trend.
    """
    keys = list(keys)
    scalars = train.groupBy(*keys).agg(
        F.min_by(value, "date").alias("first_value"),
        F.max_by(value, "date").alias("last_value"),
        F.count(F.lit(1)).alias("n"),
        ratio(money_sum(value), F.count(value)).alias("mean_value"),
        F.percentile(value, F.lit(0.5)).alias("median_value"),
        F.max("date").alias("last_date"),
    )
    by_day = train.groupBy(*keys, F.dayofyear("date").alias("doy")).agg(
        F.percentile(value, F.lit(0.5)).alias("day_median")
    )
    if level == "trend":
        parts = decompose(train, value, keys)
        last_trend = parts.groupBy(*keys).agg(F.max_by("trend", "date").alias("level_value"))
        detrended = parts.groupBy(*keys, F.dayofyear("date").alias("doy")).agg(
            F.percentile("detrended", F.lit(0.5)).alias("day_effect")
        )
        by_day = by_day.join(detrended, [*keys, "doy"])
        if keys:
            scalars = scalars.join(last_trend, keys)
        else:
            scalars = scalars.withColumn("level_value", last_trend.scalar())
    else:
        scalars = scalars.withColumn("level_value", F.col("mean_value"))
        by_day = by_day.withColumn("day_effect", F.col("day_median"))
    ahead = unfold_horizon(scalars, days).withColumn("doy", F.dayofyear("date"))
    joined = ahead.join(by_day, [*keys, "doy"], "left")
    drift = ratio(F.col("last_value") - F.col("first_value"), "n")
    out = joined.select(
        *keys,
        "date",
        (F.col("first_value") + drift * F.col("step")).alias("forecast_drift"),
        F.coalesce("day_median", "median_value").alias("forecast_seasonal_naive"),
        (F.col("level_value") + F.coalesce("day_effect", F.lit(0.0))).alias("forecast_trend_seasonal"),
    )
    mean = (
        F.col("forecast_drift") + F.col("forecast_seasonal_naive") + F.col("forecast_trend_seasonal")
    ) / F.lit(3.0)
    return out.withColumn("forecast_ensemble", mean)


# Growth and seasonal profile -------------------------------------------------------------------


def seasonal_profile(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean over the years of value / year mean, by month and day."""
    year = W.partitionBy(*keys, F.year("date"))
    scaled = df.select(
        *keys,
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
        *[ratio(v, ratio(F.sum(money(v)).over(year), F.count(v).over(year))).alias(v) for v in values],
    )
    return scaled.groupBy(*keys, "month", "day").agg(*[F.avg(v).alias(f"{v}_norm") for v in values])


def annual_totals(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Yearly sums, whether the year is whole, and change from the year before."""
    years = df.groupBy(*keys, F.year("date").alias("year")).agg(
        *[money_sum(v).alias(v) for v in values], (F.count_distinct("date") >= DAYS_PER_YEAR).alias("is_full")
    )
    w = series_window(keys).orderBy("year")
    return years.withColumns({f"{v}_yoy": ratio(F.col(v) - F.lag(v).over(w), F.lag(v).over(w)) for v in values})


def growth(totals: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Geometric mean yearly growth over the whole years, and the level to start from.

    The product of consecutive growth factors is the last total over the first.
    """
    full = totals.filter("is_full")
    aggs: list[Column] = [F.max("year").alias("base_year"), F.count(F.lit(1)).alias("full_years")]
    for v in values:
        steps = F.count(F.lit(1)) - 1
        rise = ratio(F.max_by(v, "year"), F.min_by(v, "year"))
        aggs.append(F.pow(rise, ratio(F.lit(1), steps)).alias(f"{v}_growth"))
        aggs.append((F.max_by(v, "year") / F.lit(float(DAYS_PER_YEAR))).alias(f"{v}_base"))
    return full.groupBy(*keys).agg(*aggs)


def apply_growth_profile(
    days: DataFrame, factors: DataFrame, profile: DataFrame, values: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """base * growth ^ (years from the base year) * profile for the given days; no profile counts as 1."""
    keys = list(keys)
    if keys:
        dated = days.join(factors, keys)
    else:
        row = factors.select(F.struct(*factors.columns)).scalar()
        dated = days.withColumn("_row", row).select("*", "_row.*").drop("_row")
    dated = dated.withColumns({"month": F.month("date"), "day": F.dayofmonth("date")})
    joined = dated.join(profile, [*keys, "month", "day"], "left")
    ahead = (F.year("date") - F.col("base_year")).cast("double")
    return joined.withColumns(
        {
            f"{v}_pred": F.col(f"{v}_base")
            * F.pow(F.col(f"{v}_growth"), ahead)
            * F.coalesce(f"{v}_norm", F.lit(1.0))
            for v in values
        }
    )


def growth_profile_forecast(
    df: DataFrame, days: int, values: Sequence[str] = ("revenue", "cogs"), keys: Sequence[str] = ()
) -> DataFrame:
    """The days after the last one, all targets at once."""
    keys = list(keys)
    ahead = unfold_horizon(df.groupBy(*keys).agg(F.max("date").alias("last_date")), days)
    factors = growth(annual_totals(df, values, keys), values, keys)
    out = apply_growth_profile(ahead, factors, seasonal_profile(df, values, keys), values, keys)
    return out.select(*keys, "date", *[f"{v}_pred" for v in values])


def growth_profile_validation(
    df: DataFrame, last_years: int = 2, values: Sequence[str] = ("revenue", "cogs"), keys: Sequence[str] = ()
) -> DataFrame:
    """Actual and predicted values of the last whole years.

    The profile comes from the years before them, so no value is judged by a profile it shaped.
    """
    keys = list(keys)
    totals = annual_totals(df, values, keys)
    last = totals.filter("is_full").select(F.max("year")).scalar()
    judged = df.filter((F.year("date") > last - last_years) & (F.year("date") <= last))
    earlier = df.filter(F.year("date") <= last - last_years)
    factors = growth(totals, values, keys)
    out = apply_growth_profile(judged, factors, seasonal_profile(earlier, values, keys), values, keys)
    return out.select(*keys, "date", *values, *[f"{v}_pred" for v in values])
