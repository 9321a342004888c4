"""Medians of earlier values against the percentile over a growing frame."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import blocks
from tallyloom.functions.series import series_window
from tallyloom.operators import expanding
from tallyloom.operators.expanding import expanding_median, smallest
from tallyloom.session import store


def test_smallest_against_sorting():
    rng = np.random.default_rng(7)
    for kinds in (1, 2, 5, 40):
        codes, before = rng.integers(0, kinds, 60), rng.integers(0, 4, kinds)
        upto = np.sort(rng.integers(1, 61, 200))
        k = np.array([rng.integers(0, n + before.sum()) for n in upto])
        found, place = smallest(codes, upto, k, before)
        for n, wanted, code, rest in zip(upto, k, found, place):
            values = np.sort(np.concatenate([np.repeat(np.arange(kinds), before), codes[:n]]))
            assert code == values[wanted] and rest == wanted - np.searchsorted(values, code)


def frame(spark, rows, seed, order="random"):
    rng = random.Random(seed)
    value = {"random": lambda i: rng.randrange(40) / 4, "rising": float, "falling": lambda i: -float(i), "one": lambda i: 5.0,
             "apart": lambda i: float((-1) ** i * (rows - i))}[order]
    out = [
        (i, rng.choice([None, "a", "hot", "hot", "hot"]), None if rng.random() < 0.1 else value(i)) for i in range(rows)
    ]
    return spark.createDataFrame(out, "at long, k string, v double").repartition(4)


def check(df, keys, block_rows):
    w = series_window(keys).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    expected = {r["at"]: r["m"] for r in df.withColumn("m", F.percentile("v", F.lit(0.5)).over(w)).collect()}
    got = {r["at"]: r["past_median"] for r in expanding_median(df, "v", ["at"], keys, block_rows=block_rows).collect()}
    assert got == expected


@pytest.mark.parametrize("keys, block_rows", [([], 30), (["k"], 30), (["k"], 10_000)])
def test_equals_percentile_over_a_growing_frame(spark, keys, block_rows):
    check(frame(spark, 600, 1), keys, block_rows)


@pytest.mark.parametrize("order", ["rising", "falling", "one", "apart"])
def test_hostile_orders(spark, order):
    check(frame(spark, 400, 2, order), [], 25)


def test_no_rows_and_no_values(spark):
    df = frame(spark, 20, 3)
    assert expanding_median(df.filter("at < 0"), "v", ["at"], ["k"]).count() == 0
    bare = expanding_median(df.withColumn("v", F.lit(None).cast("double")), "v", ["at"], ["k"])
    assert [r["past_median"] for r in bare.collect()] == [None] * 20


def test_series_within_and_across_blocks(spark):
    """Falling levels from series to series share cells; a series ends in blocks without values."""
    levels = {None: 50.0, "a": 40.0, "b": 30.0, "c": -30.0, "d": float("inf"), "e": 0.0}
    lengths = {None: 3, "a": 2, "b": 160, "c": 41, "d": 7, "e": 90}
    rows = [
        (at, k, None if k == "e" and at >= 5 else levels[k] + (at * 7 % 11 if k != "d" else 0))
        for k, n in lengths.items()
        for at in range(n)
    ]
    df = spark.createDataFrame([(i, at, k, v) for i, (at, k, v) in enumerate(rows)], "id long, at long, k string, v double")
    w = series_window(["k"]).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    expected = {r["id"]: r["m"] for r in df.withColumn("m", F.percentile("v", F.lit(0.5)).over(w)).collect()}
    got = {r["id"]: r["past_median"] for r in expanding_median(df, "v", ["at"], ["k"], block_rows=20).collect()}
    assert got == expected


@pytest.mark.parametrize("order", ["random", "apart"])
def test_no_stored_frame_has_more_rows_than_the_input(spark, monkeypatch, order):
    """Answers are found block by block: rows do not become questions that are numbered and written."""
    written = []

    def counted(df, label):
        out = store(df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(blocks, "store", counted)
    monkeypatch.setattr(expanding, "store", counted)
    expanding_median(frame(spark, 900, 4, order), "v", ["at"], ["k"], block_rows=50)
    assert written and all(rows <= 900 for _, rows in written), written


def test_equal_without_broadcast_of_the_cells(spark, monkeypatch):
    monkeypatch.setattr(expanding, "FEW_ROWS", 0)
    check(frame(spark, 400, 5, "apart"), ["k"], 25)
