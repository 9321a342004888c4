"""Windows in blocks against the same windows in one task."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import blocks as b
from tallyloom.functions import series as s

COLUMNS = ["id", "k", "at", "v"]


def frame(spark, rows, seed):
    """One key holds half of the rows; keys and values hold nulls, times repeat."""
    rng = random.Random(seed)
    keys = [None, "a", "b", "hot", "hot", "hot"]
    out = [
        (i, rng.choice(keys), rng.randrange(rows), None if rng.random() < 0.1 else float(rng.randrange(50)))
        for i in range(rows)
    ]
    return spark.createDataFrame(out, "id long, k string, at long, v double").repartition(5)


def same(one, two):
    names = sorted(one.columns)
    assert names == sorted(two.columns)
    left, right = ({r["id"]: r for r in df.select(names).collect()} for df in (one, two))
    assert left.keys() == right.keys()
    for key, row in left.items():
        for name in names:
            expected = right[key][name]
            if isinstance(expected, float):
                expected = pytest.approx(expected, rel=1e-9)
            assert row[name] == expected, (key, name)


def stats(keys, date):
    return {
        "lag": s.lag("v", 3, keys, date),
        "trail": s.trailing(F.sum("v"), 9, keys, date),
        "mid": s.centred(F.avg("v"), "v", 11, keys, date),
        "past": s.previous(F.max("v"), "v", 7, keys, date),
    }


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("block_rows", [3, 40, 10_000])
def test_frames_equal_one_window(spark, keys, block_rows):
    df = frame(spark, 400, 1)
    got = b.by_blocks(df, ["at", "id"], lambda x, by: x.withColumns(stats(by, b.POSITION)), 10, 6, keys, block_rows)
    one = df.withColumn("when", F.struct("at", "id"))
    same(got, one.withColumns(stats(keys, "when")).drop("when"))


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("block_rows, strict", [(2, False), (7, True), (64, False), (10_000, True)])
def test_running_equals_one_window(spark, keys, block_rows, strict):
    df = frame(spark, 300, 2)
    stats_ = {"total": ("sum", "v"), "n": ("count", "v"), "low": ("min", "v"), "high": ("max", "v")}
    got = b.running(df, ["at", "id"], stats_, keys, strict, block_rows)
    w = s.series_window(keys).orderBy("at", "id").rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    whole = {"total": F.sum("v"), "n": F.count("v"), "low": F.min("v"), "high": F.max("v")}
    same(got, df.withColumns({n: c.over(w) for n, c in whole.items()}))


def test_positions_have_no_gaps_and_follow_the_order(spark):
    df = frame(spark, 500, 3)
    x, rows = b.numbered(df, ["at", "id"], ["k"])
    got = x.orderBy(b.POSITION).collect()
    assert rows == 500 and [r[b.POSITION] for r in got] == list(range(500))
    order = [(r.k is not None, r.k or "", r.at, r.id) for r in got]
    assert order == sorted(order)


def test_empty_frame(spark):
    df = frame(spark, 5, 4).filter("id < 0")
    got = b.by_blocks(df, ["at"], lambda x, by: x.withColumns(stats(by, b.POSITION)), 10, 6)
    assert got.count() == 0 and set(got.columns) == {*COLUMNS, "lag", "trail", "mid", "past"}
    assert b.running(df, ["at"], {"n": ("count", "v")}).count() == 0


def test_no_task_sorts_the_whole_series(spark):
    df = frame(spark, 500, 5)
    frames = b.by_blocks(df, ["at", "id"], lambda x, by: x.withColumns(stats(by, b.POSITION)), 10, 6, [], 50)
    totals = b.running(df, ["at", "id"], {"n": ("count", "v")}, [], False, 50)
    for out in (frames, totals):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
        assert "_block" in plan.split("Window")[1]
