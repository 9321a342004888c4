"""Feature columns for daily series: calendar, lags, rolling statistics, momentum, profiles.

Everything looks strictly backwards from the row, in rows of its own series, and null stands for
history that is not there yet. All lags and rolling windows share one sort of each series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.expr import calendar_columns, ratio
from tallyloom.functions.series import lag, previous, row_position

# Fixed values.
MAX_LAG = 365
BASE_LAGS = (1, 7, 14, 28, 56, 365)
BASE_MEANS = (7, 28)
LAGS = (1, 2, 3, 7, 14, 21, 28, 56, 84, 168, 365)
WINDOWS = (7, 14, 28, 56)
STATS = ("mean", "std", "min", "max")

CALENDAR = (
    "dow", "month", "day", "quarter", "week_of_year", "day_of_year", "is_weekend", "is_month_start",
    "is_month_end", "sin_doy_1", "cos_doy_1", "sin_doy_2", "cos_doy_2",
)
BASIC_CALENDAR = ("dow", "month", "day", "day_of_year", "sin_doy_1", "cos_doy_1")
MOMENTUM = ("mom_7", "mom_28", "ratio_7_28")
PROFILES = ("dow_profile", "doy_profile")

BASELINE_FEATURES = (
    *BASIC_CALENDAR,
    "trend_idx",
    *[f"lag_{k}" for k in BASE_LAGS],
    *[f"roll_mean_{w}" for w in BASE_MEANS],
)
EXTENDED_FEATURES = (
    *CALENDAR,
    "trend_idx",
    *MOMENTUM,
    *PROFILES,
    *[f"lag_{k}" for k in LAGS],
    *[f"roll_{s}_{w}" for w in WINDOWS for s in STATS],
)
CROSS_FEATURES = (
    "spread_lag_1", "spread_lag_7", "ratio_lag_1", "ratio_roll_7", "rev_mom_7", "rev_mom_28", "cogs_mom_7", "cogs_mom_28",
)
DUAL_FEATURES = (
    *CALENDAR,
    "trend_idx",
    *[f"{p}_lag_{k}" for p in ("rev", "cogs") for k in LAGS],
    *[f"{p}_roll_{s}_{w}" for p in ("rev", "cogs") for w in WINDOWS for s in STATS],
    *CROSS_FEATURES,
)

FEATURE_GROUPS = {
    "lag": [f"lag_{k}" for k in LAGS],
    "rolling": [f"roll_{s}_{w}" for w in WINDOWS for s in STATS],
    "calendar": [c for c in CALENDAR if not c.startswith(("sin", "cos"))] + ["trend_idx"],
    "seasonality": ["sin_doy_1", "cos_doy_1", "sin_doy_2", "cos_doy_2", *PROFILES],
    "momentum": list(MOMENTUM),
}


def basic_calendar(df: DataFrame, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Weekday, month, day, day of year with one harmonic, and the position in the series."""
    cal = calendar_columns(date)
    cols = {c: cal[c] for c in BASIC_CALENDAR}
    return df.withColumns({**cols, "trend_idx": row_position(keys, date).cast("double")})


def extended_calendar(df: DataFrame, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """The full calendar set with two harmonics, and the position in the series."""
    return df.withColumns({**calendar_columns(date), "trend_idx": row_position(keys, date).cast("double")})


def _reducer(stat: str, value: str) -> Column:
    return {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[stat](value)


def lags(value: str, keys: Sequence[str], which: Sequence[int] = LAGS, prefix: str = "", date: str = "date") -> dict[str, Column]:
    return {f"{prefix}lag_{k}": lag(value, k, keys, date) for k in which}


def rolling(
    value: str,
    keys: Sequence[str],
    windows: Sequence[int] = WINDOWS,
    stats: Sequence[str] = STATS,
    prefix: str = "",
    date: str = "date",
) -> dict[str, Column]:
    """Statistics of the rows before this one; null until the window is full."""
    return {
        f"{prefix}roll_{s}_{w}": previous(_reducer(s, value), value, w, keys, date) for w in windows for s in stats
    }


def momentum() -> dict[str, Column]:
    """From lags and rolling means already in the frame."""
    return {
        "mom_7": F.col("lag_1") - F.col("lag_7"),
        "mom_28": F.col("lag_1") - F.col("lag_28"),
        "ratio_7_28": ratio(F.col("roll_mean_7") + 1.0, F.col("roll_mean_28") + 1.0),
    }


def causal_profiles(value: str, keys: Sequence[str], date: str = "date") -> dict[str, Column]:
    """Medians of the strictly earlier values of the same weekday and of the same day of year."""

    def past(part: Column) -> Column:
        frame = W.partitionBy(*keys, part).orderBy(date).rowsBetween(W.unboundedPreceding, -1)
        return F.percentile(value, F.lit(0.5)).over(frame)

    return {"dow_profile": past(F.weekday(date)), "doy_profile": past(F.dayofyear(date))}


def whole_profiles(value: str, keys: Sequence[str], date: str = "date") -> dict[str, Column]:
    """The same medians over the whole frame, the row's own value included.

    This leaks the target into its own features; use it to describe a series, not to train.
    """

    def all_rows(part: Column) -> Column:
        return F.percentile(value, F.lit(0.5)).over(W.partitionBy(*keys, part))

    return {"dow_profile": all_rows(F.weekday(date)), "doy_profile": all_rows(F.dayofyear(date))}


def baseline_features(df: DataFrame, value: str = "revenue", keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """15 features: basic calendar, six lags, two rolling means."""
    return basic_calendar(df, keys, date).withColumns(
        {**lags(value, keys, BASE_LAGS, date=date), **rolling(value, keys, BASE_MEANS, ("mean",), date=date)}
    )


def extended_features(
    df: DataFrame, value: str = "revenue", keys: Sequence[str] = (), causal: bool = True, date: str = "date"
) -> DataFrame:
    """46 features; a missing profile falls back to the 28-row mean."""
    out = extended_calendar(df, keys, date).withColumns({**lags(value, keys, date=date), **rolling(value, keys, date=date)})
    profiles = causal_profiles(value, keys, date) if causal else whole_profiles(value, keys, date)
    out = out.withColumns({**momentum(), **profiles})
    return out.withColumns({p: F.coalesce(F.col(p), F.col("roll_mean_28")) for p in PROFILES})


def cross_target() -> dict[str, Column]:
    """Revenue against cost of goods, from the dual lags and means already in the frame."""
    c = F.col
    one = F.lit(1.0)
    return {
        "spread_lag_1": c("rev_lag_1") - c("cogs_lag_1"),
        "spread_lag_7": c("rev_lag_7") - c("cogs_lag_7"),
        "ratio_lag_1": ratio("cogs_lag_1", F.greatest(c("rev_lag_1"), one)),
        "ratio_roll_7": ratio("cogs_roll_mean_7", F.greatest(c("rev_roll_mean_7"), one)),
        "rev_mom_7": c("rev_lag_1") - c("rev_lag_7"),
        "rev_mom_28": c("rev_lag_1") - c("rev_lag_28"),
        "cogs_mom_7": c("cogs_lag_1") - c("cogs_lag_7"),
        "cogs_mom_28": c("cogs_lag_1") - c("cogs_lag_28"),
    }


def dual_features(df: DataFrame, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """76 features of revenue and cost of goods together."""
    out = extended_calendar(df, keys, date)
    for value, prefix in (("revenue", "rev_"), ("cogs", "cogs_")):
        out = out.withColumns(
            {**lags(value, keys, prefix=prefix, date=date), **rolling(value, keys, prefix=prefix, date=date)}
        )
    return out.withColumns(cross_target())


def supervised(featured: DataFrame, features: Sequence[str], targets: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows with a full year of history and no missing feature."""
    kept = featured.filter(F.col("trend_idx") >= MAX_LAG).select(*keys, "date", *features, *targets)
    return kept.dropna(subset=[*features, *targets])
