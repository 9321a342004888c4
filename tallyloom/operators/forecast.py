"""Forecasters of many daily series: folds, seasonal naive, linear and boosted-tree models.

Models are fitted by Spark on the pooled rows of all series. A recursive forecast needs its own
earlier predictions; ``rollout`` takes each step for all series of a batch at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.expr import ratio
from tallyloom.functions.series import series_window
from tallyloom.operators import features as feats
from tallyloom.operators import short_boosting as short
from tallyloom.operators.rollout import BY_MODEL, SHORT_HISTORY, one_target, roll_out, two_targets  # noqa: F401
from tallyloom.session import scratch_path, scratch_root, ship_package

HORIZON = 120
N_FOLDS = 3
SEED = 42

# The two parameter sets and blend weights that are compared.
PARAM_GRID = (
    {"maxIter": 180, "stepSize": 0.05, "maxDepth": 3, "subsamplingRate": 0.9, "minInstancesPerNode": 10},
    {"maxIter": 260, "stepSize": 0.035, "maxDepth": 4, "subsamplingRate": 0.85, "minInstancesPerNode": 12},
)
BLEND_ALPHAS = (0.75, 0.9)
DUAL_ALPHAS = (0.6, 0.7, 0.8, 0.9)


# Folds -----------------------------------------------------------------------------------------


def fold_bounds(last: Column, horizon: int = HORIZON, n_folds: int = N_FOLDS) -> Column:
    """Array of (fold_id, train_end, valid_start, valid_end), oldest first, ending on ``last``."""
    folds = []
    for k in range(1, n_folds + 1):
        back = (n_folds - k) * horizon
        folds.append(
            F.struct(
                F.lit(k).alias("fold_id"),
                F.date_sub(last, back + horizon).alias("train_end"),
                F.date_sub(last, back + horizon - 1).alias("valid_start"),
                F.date_sub(last, back).alias("valid_end"),
            )
        )
    return F.array(*folds)


def build_folds(df: DataFrame, horizon: int = HORIZON, n_folds: int = N_FOLDS, date: str = "date") -> DataFrame:
    """Contiguous validation windows at the end of the data, with an expanding training part."""
    return df.agg(F.max(date).alias("_last")).select(F.inline(fold_bounds(F.col("_last"), horizon, n_folds)))


def _last_date(df: DataFrame, date: str) -> Column:
    return df.select(F.max(date)).scalar()


def training_rows(df: DataFrame, horizon: int = HORIZON, n_folds: int = N_FOLDS, date: str = "date") -> DataFrame:
    """Each row once per fold it may train; for daily series, not for order lines."""
    folds = fold_bounds(_last_date(df, date), horizon, n_folds)
    out = df.select("*", F.inline(folds)).filter(F.col(date) <= F.col("train_end"))
    return out.drop("train_end", "valid_start", "valid_end")


def validation_rows(df: DataFrame, horizon: int = HORIZON, n_folds: int = N_FOLDS, date: str = "date") -> DataFrame:
    """Rows of the validation windows with their fold; a date belongs to one fold only."""
    age = F.datediff(_last_date(df, date), F.col(date))
    fold = F.lit(n_folds) - F.floor(age / F.lit(horizon)).cast("int")
    return df.withColumn("fold_id", fold).filter(F.col("fold_id") >= 1)


# Seasonal naive --------------------------------------------------------------------------------


def seasonal_naive(
    train: DataFrame, days: int, season: int, value: str = "revenue", keys: Sequence[str] = (), date: str = "date"
) -> DataFrame:
    """Repeat the last season for ``days`` days.

    Feeding each forecast back as history gives the same numbers as reading the last season in a
    circle, so no recursion is needed: each of the last ``season`` rows knows the days it stands for.
    """
    w = series_window(keys)
    tail = (
        train.withColumn("_slot", F.lit(season) - F.row_number().over(w.orderBy(F.col(date).desc())))
        .withColumn("_last", F.max(date).over(w))
        .filter((F.col("_slot") >= 0) & (F.col("_slot") < days))
    )
    steps = tail.select(
        *keys, F.col(value).alias("predicted"), "_last",
        F.explode(F.sequence(F.col("_slot") + 1, F.lit(days), F.lit(season))).alias("step"),
    )
    return steps.select(*keys, F.date_add("_last", F.col("step")).alias(date), "step", "predicted")


# Fitted models ---------------------------------------------------------------------------------


def _partitions_for(rows: int) -> int:
    """Boosting runs a job per tree level: as few partitions as the rows fill, not more."""
    return max(1, rows // 50_000)


def with_vector(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=name, handleInvalid="error").transform(df)


def _training_frame(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Feature vectors written once to the shared folder and read back for every pass of a fit."""
    spark = rows.sparkSession
    path = scratch_path(spark, "train")
    with_vector(rows, features).select("features", F.col(target).alias("label")).write.parquet(path)
    stored = spark.read.parquet(path)
    return stored.coalesce(_partitions_for(stored.count()))


def fit_linear(rows: DataFrame, features: Sequence[str], target: str):
    """Least squares by the normal equations: one pass, whatever the number of series."""
    return LinearRegression(solver="normal", regParam=0.0, labelCol=target).fit(with_vector(rows, features))


def fit_boosted(
    rows: DataFrame, features: Sequence[str], target: str, params: dict, seed: int = SEED
) -> GBTRegressionModel | ShortModel:
    """Gradient-boosted trees. A short frame is fitted in one task, a long one by ``pyspark.ml``, whose training
    state is cut every ten trees in the checkpoint folder; the trees are the same."""
    scratch_root(rows.sparkSession)
    frame = _training_frame(rows, features, target)
    if 0 < frame.count() <= short.MOST_ROWS and params.keys() <= short.DEFAULTS.keys():
        p = short.DEFAULTS | params
        arrays, depth, importances = short.fit(frame, p, seed)
        weights = np.array([1.0] + [p["stepSize"]] * (p["maxIter"] - 1))
        return ShortModel(Scorer(tuple(features), weights=weights, depth=depth, **arrays), importances)
    frame = frame.cache()
    try:
        return GBTRegressor(seed=seed, maxBins=short.BINS, checkpointInterval=10, **params).fit(frame)
    finally:
        frame.unpersist()


def fit_all(fits: dict, parallelism: int = 6) -> dict:
    """Run independent fits side by side.

    A fit is a long chain of small jobs that leaves most of the cluster idle; the driver threads
    here only submit jobs.
    """
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        running = {name: pool.submit(inherit(fit)) for name, fit in fits.items()}
        return {name: r.result() for name, r in running.items()}


@dataclass
class Scorer:
    """A fitted model as plain arrays, small enough to travel with the task closure.

    A linear model is its coefficients; a boosted model is one row of node arrays per tree, whose
    size depends on tree count and depth, never on the data.
    """

    features: tuple[str, ...]
    intercept: float = 0.0
    coefficients: np.ndarray | None = None
    weights: np.ndarray | None = None
    feature: np.ndarray | None = None
    threshold: np.ndarray | None = None
    left: np.ndarray | None = None
    right: np.ndarray | None = None
    value: np.ndarray | None = None
    depth: int = 0

    def predict(self, x: np.ndarray) -> float:
        return float(self.predict_many(x[None, :])[0])

    def predict_many(self, x: np.ndarray) -> np.ndarray:
        """Predictions for the rows of a matrix; all rows walk all trees together.

        Sums go row by row, so that a prediction does not depend on the rows beside it.
        """
        if self.coefficients is not None:
            return (x * self.coefficients).sum(axis=1) + self.intercept
        trees, rows = np.arange(len(self.weights)), np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.weights)), dtype=np.int64)
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[trees, node]] <= self.threshold[trees, node]
            node = np.where(goes_left, self.left[trees, node], self.right[trees, node])
        return (self.value[trees, node] * self.weights).sum(axis=1)


@dataclass
class ShortModel:
    """Boosted trees that one task grew, with what callers ask of a ``GBTRegressionModel``."""

    scorer: Scorer
    importances: np.ndarray

    @property
    def featureImportances(self) -> DenseVector:
        return Vectors.dense(self.importances)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the column ``prediction`` from its column ``features``."""
        ship_package(df.sparkSession)
        scorer = self.scorer

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(scorer.predict_many(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

        return df.withColumn("prediction", score(vector_to_array("features")))


def linear_scorer(model, features: Sequence[str]) -> Scorer:
    return Scorer(tuple(features), float(model.intercept), np.asarray(model.coefficients.toArray()))


def boosted_scorer(model: GBTRegressionModel | ShortModel, features: Sequence[str], spark) -> Scorer:
    """Read the nodes of a stored model; a leaf points at itself, so every tree takes ``depth`` steps."""
    if isinstance(model, ShortModel):
        return model.scorer
    path = scratch_path(spark, "gbt")
    model.write().overwrite().save(path)
    split = "nodeData.split"
    nodes = (
        spark.read.parquet(f"{path}/data")
        .select(
            "treeID",
            F.col("nodeData.id").alias("id"),
            F.col("nodeData.prediction").alias("value"),
            F.col("nodeData.leftChild").alias("left"),
            F.col("nodeData.rightChild").alias("right"),
            F.col(f"{split}.featureIndex").alias("feature"),
            F.try_element_at(f"{split}.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
        )
        .toPandas()
    )
    shape = (model.getNumTrees, int(nodes["id"].max()) + 1)
    leaf = nodes["left"] < 0
    nodes.loc[leaf, ["left", "right"]] = np.repeat(nodes.loc[leaf, ["id"]].to_numpy(), 2, axis=1)
    nodes.loc[leaf, "feature"] = 0
    nodes.loc[leaf, "threshold"] = np.inf
    arrays = {}
    for name, kind in (("feature", np.int64), ("threshold", float), ("left", np.int64), ("right", np.int64), ("value", float)):
        filled = np.zeros(shape, dtype=kind)
        filled[nodes["treeID"].to_numpy(), nodes["id"].to_numpy()] = nodes[name].to_numpy()
        arrays[name] = filled
    return Scorer(
        tuple(features), weights=np.asarray(model.treeWeights), depth=max(t.depth for t in model.trees), **arrays
    )


# Recursive forecasts ---------------------------------------------------------------------------


def recursive_forecast(
    train: DataFrame, days: int, scorer: Scorer, value: str = "revenue", keys: Sequence[str] = ()
) -> DataFrame:
    """One target, day after day, each prediction becoming history; never below zero."""
    return roll_out(train, days, [scorer], [value], ["predicted"], one_target, keys)


def recursive_forecast_by_fold(
    train: DataFrame, days: int, scorers: dict[int, Scorer], value: str = "revenue", keys: Sequence[str] = ()
) -> DataFrame:
    """The same with one model per fold; ``train`` carries ``fold_id``."""
    parts = [
        recursive_forecast(train.filter(F.col("fold_id") == fold), days, scorer, value, ["fold_id", *keys])
        for fold, scorer in scorers.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def recursive_dual_forecast(
    train: DataFrame, days: int, revenue: Scorer, cogs: Scorer, keys: Sequence[str] = ()
) -> DataFrame:
    """Revenue and cost of goods together: each prediction feeds the features of both."""
    return roll_out(train, days, [revenue, cogs], ["revenue", "cogs"], ["revenue_raw", "cogs_raw"], two_targets, keys)


# Combination -----------------------------------------------------------------------------------


def align(forecasts: dict[str, DataFrame], keys: Sequence[str] = (), value: str = "predicted") -> DataFrame:
    """Forecasts side by side, matched on series and date; null where one has no value for the day."""
    out = None
    for name, df in forecasts.items():
        part = df.select(*keys, "date", F.col(value).alias(name))
        out = part if out is None else out.join(part, [*keys, "date"], "full")
    return out


def blend(model: str | Column, seasonal: str | Column, alpha: float | Column) -> Column:
    """alpha * model + (1 - alpha) * seasonal; where one is missing, the other."""
    model = F.col(model) if isinstance(model, str) else model
    seasonal = F.col(seasonal) if isinstance(seasonal, str) else seasonal
    alpha = F.lit(alpha) if isinstance(alpha, float) else alpha
    return F.coalesce(alpha * model + (F.lit(1.0) - alpha) * seasonal, model, seasonal)


def equal_weight(names: Sequence[str]) -> Column:
    """The mean of the forecasts that there are for the day."""
    total, known = F.lit(0.0), F.lit(0.0)
    for n in names:
        total = total + F.coalesce(F.col(n), F.lit(0.0))
        known = known + F.col(n).isNotNull().cast("double")
    return ratio(total, known)


def post_process(df: DataFrame, revenue: str, cogs: str, cap: float = 0.999) -> DataFrame:
    """No negative value, and cost of goods below revenue."""
    return df.withColumn(revenue, F.greatest(revenue, F.lit(0.0))).withColumn(
        cogs, F.least(F.greatest(cogs, F.lit(0.0)), F.col(revenue) * F.lit(cap))
    )


def forecast_detail(wide: DataFrame, candidates: Sequence[str], selected: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """All candidate forecasts, the name of the chosen one and its values, floored at zero."""
    selected = F.lit(selected) if isinstance(selected, str) else selected
    chosen = None
    for c in candidates:
        hit = selected == F.lit(c)
        chosen = F.when(hit, F.col(c)) if chosen is None else chosen.when(hit, F.col(c))
    return wide.select(
        *keys,
        "date",
        *[F.col(c).alias(f"forecast_{c}") for c in candidates],
        selected.alias("selected_model"),
        F.greatest(chosen, F.lit(0.0)).alias("forecast_selected"),
    )
