"""Boosted trees grown in one task: held against pyspark.ml, and counted in jobs."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor

from tallyloom.operators import forecast as f

PARAMS = {"maxIter": 12, "stepSize": 0.2, "maxDepth": 4, "subsamplingRate": 0.85, "minInstancesPerNode": 5}
NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(0, 10, 700), rng.integers(0, 4, 700).astype(float), np.zeros(700)
    y = a * a + 5 * b + rng.normal(0, 1, 700)
    lines = [tuple(map(float, r)) for r in zip(a, b, c, a, y)]
    return spark.createDataFrame(lines, "a double, b double, c double, d double, y double").coalesce(1).cache()


@pytest.mark.parametrize("params", [PARAMS, {"maxIter": 4, "maxDepth": 5}])
def test_trees_equal_those_of_the_library(spark, rows, params):
    """Shared values, a constant feature, and two equal features whose gains tie."""
    model = f.fit_boosted(rows, NAMES, "y", params)
    frame = f._training_frame(rows, NAMES, "y")
    library = GBTRegressor(seed=f.SEED, maxBins=64, **params).fit(frame)
    got, want = f.boosted_scorer(model, NAMES, spark), f.boosted_scorer(library, NAMES, spark)
    assert isinstance(model, f.ShortModel) and got.depth == want.depth
    for name in ("feature", "left", "right", "threshold", "value", "weights"):
        assert np.array_equal(getattr(got, name), getattr(want, name)), name
    assert model.featureImportances.toArray() == pytest.approx(library.featureImportances.toArray(), rel=1e-12)
    both = [
        [r.prediction for r in m.transform(f.with_vector(rows, NAMES)).select("prediction").collect()] for m in (model, library)
    ]
    assert both[0] == pytest.approx(both[1], rel=1e-12)


def test_a_short_frame_takes_few_jobs_and_a_long_one_goes_to_the_library(spark, rows, monkeypatch):
    spark.sparkContext.setJobGroup("short", "one fit")
    f.fit_boosted(rows, NAMES, "y", PARAMS)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("short"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 15  # a library fit runs one for every level of every tree
    monkeypatch.setattr(f.short, "MOST_ROWS", 100)
    assert not isinstance(f.fit_boosted(rows, NAMES, "y", {"maxIter": 2}), f.ShortModel)


def test_one_row_and_a_constant_target(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "a double, y double")
    assert f.fit_boosted(one, ["a"], "y", {"maxIter": 3}).scorer.predict(np.array([1.0])) == 2.0
    flat = spark.createDataFrame([(float(i), 4.0) for i in range(30)], "a double, y double")
    model = f.fit_boosted(flat, ["a"], "y", {"maxIter": 3})
    assert model.scorer.predict(np.array([3.0])) == 4.0 and not model.featureImportances.toArray().any()
