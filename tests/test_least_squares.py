"""Merged co-moments against whole ones, and the models of all folds against direct fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import forecast as f
from tallyloom.operators import least_squares as ls


def frame(spark, n=700, level=1e7):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (n, 3)) * [1.0, 50.0, 0.01] + [level, 0.0, 5.0]
    y = x @ [2.0, -0.3, 70.0] + rng.normal(0, 0.5, n)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "day int, a double, b double, c double, y double").repartition(5)
    return df.withColumn("date", F.date_add(F.lit("2015-01-01"), F.col("day"))), x, y


def direct(x, y):
    design = np.column_stack([x - x.mean(axis=0), np.ones(len(x))])
    found = np.linalg.lstsq(design, y, rcond=None)[0]
    return found[:-1], found[-1] - found[:-1] @ x.mean(axis=0)


def test_every_fold_equals_a_direct_fit(spark):
    df, x, y = frame(spark)
    last = df.select(F.max("date")).scalar()
    blocks = ls.moments(df, ["a", "b", "c", "y"], ls.fold_block(last, 120, 3))
    assert sorted(blocks) == [1, 2, 3, 4] and [blocks[k].n for k in (1, 2, 3, 4)] == [340, 120, 120, 120]
    for fold, n in ((1, 340), (2, 460), (3, 580), (4, 700)):
        slopes, intercept = ls.up_to(blocks, fold).solve()
        expected, base = direct(x[:n], y[:n])
        assert slopes == pytest.approx(expected, rel=1e-7) and intercept == pytest.approx(base, rel=1e-6)
    # The blocks are those of the folds that forecasts are judged on.
    trained = f.training_rows(df).groupBy("fold_id").count().collect()
    assert {r.fold_id: r["count"] for r in trained} == {k: ls.up_to(blocks, k).n for k in (1, 2, 3)}


def test_merging_is_exact_and_in_any_order(spark):
    df, x, y = frame(spark, 300)
    whole = ls.moments(df, ["a", "b", "c", "y"], F.lit(0))[0]
    parts = ls.moments(df, ["a", "b", "c", "y"], F.col("day") % 7)
    forwards = sum((parts[k] for k in range(1, 7)), parts[0])
    backwards = sum((parts[k] for k in range(5, -1, -1)), parts[6])
    for merged in (forwards, backwards):
        assert merged.n == whole.n and merged.mean == pytest.approx(whole.mean, rel=1e-12)
        spread = np.sqrt(np.diag(whole.products))
        assert np.abs((merged.products - whole.products) / np.outer(spread, spread)).max() < 1e-9


def test_constant_and_repeated_columns(spark):
    rows = [(1.0, float(i), float(i), 3.0 * i + 2) for i in range(50)]
    df = spark.createDataFrame(rows, "one double, a double, b double, y double")
    slopes, intercept = ls.moments(df, ["one", "a", "b", "y"], F.lit(0))[0].solve()
    assert slopes[0] == 0 and slopes[1] + slopes[2] == pytest.approx(3) and intercept == pytest.approx(2)
    assert ls.moments(df.limit(0), ["a", "y"], F.lit(0)) == {}
    alone = ls.moments(df.limit(1), ["a", "y"], F.lit(0))[0].solve()
    assert alone[0].tolist() == [0.0] and alone[1] == df.first()["y"]
