import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import boosting as B


def frame(spark, n=500, parts=3):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 5)).round(2)
    y = np.where(x[:, 0] > 0.3, 4.0, -1.0) + 2.0 * x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.3, n)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "i int, a double, b double, c double, d double, e double, y double").repartition(parts, "i")


NAMES = ["a", "b", "c", "d", "e"]


def one_split_at_a_time(x, y, ids, edges, p):
    """The booster on raw rows: the leaf of the greatest gain is split, every cut of every leaf tried."""

    def part(rows, g):
        s = g[rows].sum()
        return (np.sign(s) * max(abs(s) - p.l1, 0.0)) ** 2 / (len(rows) + p.l2)

    def best(rows, g, columns):
        found = (0.0, None)
        for j in columns:
            for edge in edges[j]:
                left, right = rows[x[rows, j] <= edge], rows[x[rows, j] > edge]
                if min(len(left), len(right)) >= p.min_rows:
                    gain = part(left, g) + part(right, g) - part(rows, g)
                    if gain > found[0] + 1e-9:
                        found = (gain, (j, edge))
        return found

    total, sizes = np.full(len(y), y.mean()), []
    for tree in range(p.trees):
        g, drawn = total - y, np.flatnonzero(B.drawn_rows(ids, p, tree))
        columns = B.drawn_columns(x.shape[1], p, tree)
        leaves = [(np.arange(len(y)), drawn, best(drawn, g, columns))]
        while len(leaves) < p.leaves:
            k = max(range(len(leaves)), key=lambda k: leaves[k][2][0])
            gain, cut = leaves[k][2]
            if gain <= 0:
                break
            every, rows, _ = leaves.pop(k)
            for side in (lambda r: x[r, cut[0]] <= cut[1], lambda r: x[r, cut[0]] > cut[1]):
                few = rows[side(rows)]
                leaves.append((every[side(every)], few, best(few, g, columns)))
        for every, rows, _ in leaves:
            s = g[rows].sum()
            total[every] -= p.step * np.sign(s) * max(abs(s) - p.l1, 0.0) / (len(rows) + p.l2)
        sizes.append(len(leaves))
    return total, sizes


PARAMS = {
    "plain": B.LeafWise(4, 0.3, leaves=9, min_rows=10),
    "drawn": B.LeafWise(13, 0.2, leaves=7, min_rows=15, row_share=0.8, column_share=0.6, l1=3.0, l2=5.0),
}


@pytest.mark.parametrize("block_rows", [B.BLOCK_ROWS, 150])
def test_all_models_of_a_fit_against_one_split_at_a_time(spark, monkeypatch, block_rows):
    monkeypatch.setattr(B, "KEEP", 3)
    monkeypatch.setattr(B, "CUT", 2)
    df = frame(spark)
    found = B.fit(df, NAMES, {k: (F.col("y"), p) for k, p in PARAMS.items()}, block_rows)
    edges = B.bin_edges(df, NAMES)
    values = [F.col(c) for c in NAMES]
    rows = df.select(*NAMES, "y", F.xxhash64(*values, "y", "y").alias("id")).toPandas()
    x, y = rows[NAMES].to_numpy(), rows["y"].to_numpy()
    ids = rows["id"].to_numpy().view(np.uint64)
    for name, p in PARAMS.items():
        want, sizes = one_split_at_a_time(x, y, ids, edges, p)
        assert np.allclose(found[name].predict_many(x), want, atol=1e-9)
        own = found[name].left != np.arange(found[name].left.shape[1])
        assert [int(n) + 1 for n in own[1:].sum(axis=1)] == sizes


def test_rows_of_a_model_are_those_with_a_target(spark):
    df, p = frame(spark), PARAMS["plain"]
    part = F.when(F.col("i") < 300, F.col("y"))
    both = B.fit(df, NAMES, {"all": (F.col("y"), p), "part": (part, p), "none": (F.lit(None), p)})
    x = df.select(*NAMES).toPandas().to_numpy()
    edges = B.bin_edges(df, NAMES)
    rows = df.filter("i < 300").toPandas()
    want, _ = one_split_at_a_time(rows[NAMES].to_numpy(), rows["y"].to_numpy(), np.arange(300), edges, p)
    assert np.allclose(both["part"].predict_many(rows[NAMES].to_numpy()), want, atol=1e-9)
    assert not np.allclose(both["all"].predict_many(x), both["part"].predict_many(x))
    assert (both["none"].predict_many(x) == 0).all()


@pytest.mark.parametrize("leaves", [2, 48])
def test_leaves_penalties_and_rows_of_a_leaf(spark, leaves):
    df = frame(spark, 3000)
    weak, strong = B.LeafWise(2, 0.5, leaves, 5), B.LeafWise(2, 0.5, leaves, 5, l1=40.0, l2=1e6)
    found = B.fit(df, NAMES, {"weak": (F.col("y"), weak), "strong": (F.col("y"), strong)})
    splits = found["weak"].left != np.arange(found["weak"].left.shape[1])
    assert (splits[1:].sum(axis=1) == leaves - 1).all()
    assert np.abs(found["strong"].value[1:]).max() < 0.01 < np.abs(found["weak"].value[1:]).max()


def test_a_constant_target_and_no_rows(spark):
    df = frame(spark, 40)
    p = B.LeafWise(3, 0.5)
    flat = B.fit(df, NAMES, {"m": (F.lit(2.5), p)})["m"]
    assert np.allclose(flat.predict_many(np.zeros((2, 5))), 2.5)
    none = B.fit(df.filter("false"), NAMES, {"m": (F.col("y"), p)})["m"]
    assert (none.predict_many(np.zeros((2, 5))) == 0).all()


def test_scores_as_a_column(spark):
    df = frame(spark, 60)
    model = B.fit(df, NAMES, {"m": (F.col("y"), PARAMS["plain"])})["m"]
    got = B.predicted(df, {"p": model}).toPandas()
    assert np.allclose(got["p"], model.predict_many(got[NAMES].to_numpy()))
