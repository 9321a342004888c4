"""Backtests: long predictions, metrics, summaries, and the choice of model and blend weight."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.expr import ratio
from tallyloom.functions.series import series_window
from tallyloom.operators.audit import union_all
from tallyloom.operators.forecast import HORIZON, N_FOLDS, blend, seasonal_naive, training_rows, validation_rows

NAIVE_SEASONS = {"seasonal_week_lag7": 7, "seasonal_year_lag365": 365}


def tail_split(df: DataFrame, rows: int, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(earlier rows, last ``rows`` rows) of every series."""
    numbered = df.withColumn("_back", F.row_number().over(series_window(keys).orderBy(F.col("date").desc())))
    return numbered.filter(F.col("_back") > rows).drop("_back"), numbered.filter(F.col("_back") <= rows).drop("_back")


def long_predictions(
    actual: DataFrame, forecasts: Mapping[str, DataFrame], value: str = "revenue", keys: Sequence[str] = ()
) -> DataFrame:
    """(fold, series, date, model, actual, predicted) for validation rows that have a forecast."""
    base = actual.select("fold_id", *keys, "date", F.col(value).alias("actual"))
    named = union_all(
        f.select("fold_id", *keys, "date", F.lit(name).alias("model"), "predicted") for name, f in forecasts.items()
    )
    return named.join(base, ["fold_id", *keys, "date"])


def naive_backtest(
    df: DataFrame, value: str = "revenue", keys: Sequence[str] = (), horizon: int = HORIZON, n_folds: int = N_FOLDS
) -> DataFrame:
    """Weekly and yearly seasonal naive over all folds and series in one plan."""
    train = training_rows(df, horizon, n_folds)
    by = ["fold_id", *keys]
    forecasts = {name: seasonal_naive(train, horizon, season, value, by) for name, season in NAIVE_SEASONS.items()}
    return long_predictions(validation_rows(df, horizon, n_folds), forecasts, value, keys)


def metrics(
    predictions: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Mean absolute error, root mean squared error and R² per group.

    The variance is an aggregate that does not cancel large values, so one pass over groups of any size
    is enough; a group without variance has no R².
    """
    by = list(by)
    error = F.col(actual) - F.col(predicted)
    squared = F.avg(error * error)
    return predictions.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(squared).alias("rmse"),
        (F.lit(1.0) - ratio(squared, F.var_pop(actual))).alias("r2"),
    )


def mape(actual: str | Column, predicted: str | Column) -> Column:
    """Aggregate: mean absolute percentage error; days with a zero actual do not count."""
    actual = F.col(actual) if isinstance(actual, str) else actual
    predicted = F.col(predicted) if isinstance(predicted, str) else predicted
    return F.avg(ratio(F.abs(actual - predicted), F.abs(actual))) * 100.0


def model_summary(fold_metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean metrics per model, dense ranks of each, their mean, best model first."""
    keys = list(keys)
    means = fold_metrics.groupBy(*keys, "model").agg(
        F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2")
    )
    w = series_window(keys)
    ranked = means.withColumns(
        {
            "rank_rmse": F.dense_rank().over(w.orderBy("rmse")),
            "rank_mae": F.dense_rank().over(w.orderBy("mae")),
            "rank_r2": F.dense_rank().over(w.orderBy(F.col("r2").desc_nulls_last())),
        }
    )
    composite = (F.col("rank_rmse") + F.col("rank_mae") + F.col("rank_r2")) / F.lit(3.0)
    return ranked.withColumn("composite_rank", composite).orderBy(*keys, "composite_rank", "rmse", "mae", "model")


def best_model(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First model of each summary; ties go to the smaller error, then to the name."""
    keys = list(keys)
    first = F.min_by(
        F.struct("model", "mae", "rmse", "r2"), F.struct("composite_rank", "rmse", "mae", "model")
    ).alias("best")
    return summary.groupBy(*keys).agg(first).select(*keys, "best.*")


def rank_on_predictions(predictions: DataFrame, summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each prediction with its model's composite rank."""
    return predictions.join(summary.select(*keys, "model", "composite_rank"), [*keys, "model"], "left")


def blend_predictions(
    predictions: DataFrame, model: str, seasonal: str, alphas: Sequence[float], by: Sequence[str]
) -> DataFrame:
    """Blends of two models for each weight, as further models."""
    by = list(by)
    wide = (
        predictions.filter(F.col("model").isin(model, seasonal))
        .groupBy(*by, "date", "actual")
        .agg(
            F.max(F.when(F.col("model") == model, F.col("predicted"))).alias("_m"),
            F.max(F.when(F.col("model") == seasonal, F.col("predicted"))).alias("_s"),
        )
    )
    lines = F.array(
        *[F.struct(F.lit(a).alias("alpha"), blend("_m", "_s", float(a)).alias("predicted")) for a in alphas]
    )
    out = wide.select(*by, "date", "actual", F.inline(lines))
    return out.withColumn("model", F.format_string("blend_alpha_%.2f", "alpha"))


def blend_weights(predictions: DataFrame, alphas: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Two-target blend weights ranked by the mean of the two absolute errors.

    Expects revenue, cogs and their ``_raw`` and ``_seasonal`` forecasts; one aggregation serves
    all weights.
    """
    by = list(by)
    lines = F.array(
        *[
            F.struct(
                F.lit(a).alias("alpha"),
                blend("revenue_raw", "revenue_seasonal", float(a)).alias("rev_pred"),
                blend("cogs_raw", "cogs_seasonal", float(a)).alias("cogs_pred"),
            )
            for a in alphas
        ]
    )
    out = predictions.select(*by, "date", "revenue", "cogs", F.inline(lines))
    group = [*by, "alpha"]
    rev = metrics(out, group, "revenue", "rev_pred").withColumnsRenamed({m: f"rev_{m}" for m in ("mae", "rmse", "r2")})
    cost = metrics(out, group, "cogs", "cogs_pred").withColumnsRenamed({m: f"cogs_{m}" for m in ("mae", "rmse", "r2")})
    both = rev.join(cost, group).withColumn("avg_mae", (F.col("rev_mae") + F.col("cogs_mae")) / F.lit(2.0))
    return both.orderBy(*by, "avg_mae", "alpha")
