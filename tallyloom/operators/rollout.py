"""Recursive forecasts of many series, all of a batch taking each step together.

A series is one row: the values of its last year as an array, its length and its last day. An Arrow
function stacks the rows of a batch into a matrix, and one day ahead is one round of column operations for
all of them: lags and rolling statistics are slices, the model scores a matrix, its answers are the next
column. Work per batch is bounded by rows of a fixed size, and a partition holds any number of series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.series import series_window
from tallyloom.operators import features as feats
from tallyloom.session import ship_package

#: How a rollout came about.
BY_MODEL, SHORT_HISTORY = "model", "short_history"
#: Series that step together; a wider matrix would only leave the processor's caches.
WIDTH = 1024


def calendar_matrix(days: np.ndarray) -> dict[str, np.ndarray]:
    """The calendar features of ``functions.expr.calendar_columns`` for an array of dates."""
    import pandas as pd

    d = pd.DatetimeIndex(days.astype("datetime64[ns]"))
    angle = d.dayofyear.to_numpy() * (2.0 * np.pi) / 365.25
    return {
        "dow": d.dayofweek.to_numpy(), "month": d.month.to_numpy(), "day": d.day.to_numpy(), "quarter": d.quarter.to_numpy(),
        "week_of_year": d.isocalendar().week.to_numpy(), "day_of_year": d.dayofyear.to_numpy(),
        "is_weekend": d.dayofweek.to_numpy() >= 5, "is_month_start": d.day.to_numpy() <= 3, "is_month_end": d.day.to_numpy() >= 28,
        "sin_doy_1": np.sin(angle), "cos_doy_1": np.cos(angle), "sin_doy_2": np.sin(angle * 2.0), "cos_doy_2": np.cos(angle * 2.0),
    }


def _history(h: np.ndarray, t: int, prefix: str = "") -> dict[str, Callable[[], np.ndarray]]:
    """Lags and rolling statistics before column t, as the window features define them."""
    out = {f"{prefix}lag_{k}": lambda k=k: h[:, t - k] for k in {*feats.LAGS, *feats.BASE_LAGS}}
    for w in feats.WINDOWS:
        last = h[:, t - w : t]
        out[f"{prefix}roll_mean_{w}"] = lambda last=last: last.mean(axis=1)
        out[f"{prefix}roll_std_{w}"] = lambda last=last: last.std(axis=1, ddof=1)
        out[f"{prefix}roll_min_{w}"] = lambda last=last: last.min(axis=1)
        out[f"{prefix}roll_max_{w}"] = lambda last=last: last.max(axis=1)
    return out


def one_target(histories: Sequence[np.ndarray], t: int) -> dict[str, Callable[[], np.ndarray]]:
    """Features of column t of one target, each computed only when a model asks for it."""
    (h,) = histories
    out = _history(h, t)
    out["mom_7"] = lambda: h[:, t - 1] - h[:, t - 7]
    out["mom_28"] = lambda: h[:, t - 1] - h[:, t - 28]
    out["ratio_7_28"] = lambda: (out["roll_mean_7"]() + 1.0) / (out["roll_mean_28"]() + 1.0)
    return out


def two_targets(histories: Sequence[np.ndarray], t: int) -> dict[str, Callable[[], np.ndarray]]:
    """Features of column t of revenue and cost of goods, and of one against the other."""
    rev, cogs = histories
    out = {**_history(rev, t, "rev_"), **_history(cogs, t, "cogs_")}
    out["spread_lag_1"] = lambda: rev[:, t - 1] - cogs[:, t - 1]
    out["spread_lag_7"] = lambda: rev[:, t - 7] - cogs[:, t - 7]
    out["ratio_lag_1"] = lambda: cogs[:, t - 1] / np.maximum(rev[:, t - 1], 1.0)
    out["ratio_roll_7"] = lambda: out["cogs_roll_mean_7"]() / np.maximum(out["rev_roll_mean_7"](), 1.0)
    for p, h in (("rev", rev), ("cogs", cogs)):
        out[f"{p}_mom_7"] = lambda h=h: h[:, t - 1] - h[:, t - 7]
        out[f"{p}_mom_28"] = lambda h=h: h[:, t - 1] - h[:, t - 28]
    return out


def step_together(
    pasts: Sequence[np.ndarray],
    length: np.ndarray,
    last: np.ndarray,
    days: int,
    scorers: Sequence,
    derive: Callable,
    profiles: dict[str, np.ndarray],
) -> list[np.ndarray]:
    """The days ahead of many series with a full year of history, one matrix per target.

    ``pasts`` are matrices of the last year, ``length`` counts all days of each series, ``last`` is its last
    day. ``profiles`` are medians by weekday and by day of year, nan where a series has none.
    """
    n, year = pasts[0].shape
    whole = [np.concatenate([p, np.empty((n, days))], axis=1) for p in pasts]
    features = scorers[0].features
    # Series mostly end on one day: the calendar is computed once for each last day.
    ends, which = np.unique(last, return_inverse=True)
    ahead = ends[:, None] + np.arange(1, days + 1)
    calendar = {k: v.reshape(ahead.shape) for k, v in calendar_matrix(ahead.ravel()).items()}
    rows = np.arange(n)
    for step in range(days):
        t = year + step
        derived = derive(whole, t)
        x = np.empty((n, len(features)))
        for j, name in enumerate(features):
            if name in calendar:
                x[:, j] = calendar[name][which, step]
            elif name == "trend_idx":
                x[:, j] = length + step
            elif name in profiles:
                part = "dow" if name == "dow_profile" else "day_of_year"
                at = calendar[part][which, step].astype(np.int64) - (part != "dow")
                known = profiles[name][rows, at]
                x[:, j] = np.where(np.isnan(known), derived["roll_mean_28"](), known)
            else:
                x[:, j] = derived[name]()
        for h, scorer in zip(whole, scorers):
            h[:, t] = np.maximum(scorer.predict_many(x), 0.0)
    return [h[:, year:] for h in whole]


def _repeat_last_week(past: np.ndarray, days: int) -> np.ndarray:
    """The last week over and over, or what there is of it; never below zero."""
    return np.maximum(np.resize(past[-7:], days), 0.0)


def _series_rows(train: DataFrame, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per series: its last day, number of days, and the values of its last year in order."""
    w = series_window(keys)
    tail = (
        train.select(*keys, "date", *[F.col(v).cast("double").alias(v) for v in values])
        .withColumns({"_back": F.row_number().over(w.orderBy(F.col("date").desc())), "_days": F.count(F.lit(1)).over(w)})
        .filter(F.col("_back") <= feats.MAX_LAG)
    )
    rows = tail.groupBy(*keys).agg(
        F.max("date").alias("_last"), F.max("_days").alias("_days"),
        F.sort_array(F.collect_list(F.struct("date", *values))).alias("_tail"),
    )
    return rows.select(*keys, "_last", "_days", *[F.col(f"_tail.{v}").alias(f"_past_{i}") for i, v in enumerate(values)])


def _with_profiles(rows: DataFrame, train: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Medians of the training values by weekday (7) and by day of year (366), as arrays."""
    for name, part, low, high in (("dow_profile", F.weekday("date"), 0, 6), ("doy_profile", F.dayofyear("date"), 1, 366)):
        medians = train.groupBy(*keys, part.alias("_part")).agg(F.percentile(value, F.lit(0.5)).alias("_median"))
        by_part = medians.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_part", "_median"))).alias("_map"))
        every = F.sequence(F.lit(low), F.lit(high))
        arrays = by_part.select(
            *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
            F.transform(every, lambda i: F.element_at("_map", i)).alias(f"_{name}"),
        )
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
        rows = rows.join(arrays, same, "left").drop(*[f"_key_{i}" for i in range(len(keys))])
    return rows


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrays of one length as a matrix; null is nan."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _roll(days: int, scorers: Sequence, derive: Callable, keys: Sequence[str], outputs: Sequence[str], profiles: Sequence[str]):
    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        length = batch.column("_days").to_numpy()
        last = batch.column("_last").to_numpy(zero_copy_only=False).astype("datetime64[D]")
        results = [np.empty((n, days)) for _ in outputs]
        full = length >= feats.MAX_LAG
        for i in np.flatnonzero(~full):
            for k, out in enumerate(results):
                out[i] = _repeat_last_week(np.array(batch.column(f"_past_{k}")[i].as_py(), dtype=float), days)
        if full.any():
            kept = batch.filter(pa.array(full))
            pasts = [_matrix(kept.column(f"_past_{k}"), feats.MAX_LAG) for k in range(len(outputs))]
            medians = {p: _matrix(kept.column(f"_{p}"), 7 if p == "dow_profile" else 366) for p in profiles}
            rolled = step_together(pasts, length[full], last[full], days, scorers, derive, medians)
            for out, values in zip(results, rolled):
                out[full] = values
        owner = pa.array(np.repeat(np.arange(n), days))
        dates = (last[:, None] + np.arange(1, days + 1)).ravel()
        status = np.where(full, BY_MODEL, SHORT_HISTORY)
        columns = [batch.column(k).take(owner) for k in keys] + [pa.array(dates)]
        columns += [pa.array(out.ravel()) for out in results] + [pa.array(np.repeat(status, days).tolist(), pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*keys, "date", *outputs, "status"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, WIDTH):
                yield block(batch.slice(start, WIDTH))

    return run


def roll_out(
    train: DataFrame,
    days: int,
    scorers: Sequence,
    values: Sequence[str],
    outputs: Sequence[str],
    derive: Callable,
    keys: Sequence[str] = (),
) -> DataFrame:
    """keys, date, one column per output, status: the days ahead of every series.

    ``scorers`` has a model per value; all read the same features. ``derive`` gives what depends on the
    histories. A series with less than a year of history has no features: it repeats its last week, and
    ``status`` says so.
    """
    ship_package(train.sparkSession)
    own = list(keys)
    if not own:
        train, own = train.withColumn("_series", F.lit("all")), ["_series"]
    profiles = [p for p in feats.PROFILES if p in scorers[0].features]
    rows = _series_rows(train, values, own)
    if profiles:
        rows = _with_profiles(rows, train, values[0], own)
    types = dict(train.dtypes)
    schema = ", ".join(
        [*(f"`{k}` {types[k]}" for k in own), "date date", *(f"{o} double" for o in outputs), "status string"]
    )
    return rows.mapInArrow(_roll(days, list(scorers), derive, own, list(outputs), profiles), schema).drop("_series")
