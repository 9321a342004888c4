import math

import numpy as np

from tallyloom.llm import cover_tree as C


def brute(rows):
    def sound(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = np.zeros((n, n), dtype=bool)
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows):
            if i != j and sound(a) and sound(b) and len(a) == len(b):
                x, y = np.array(a), np.array(b)
                near[i, j] = x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9
    root = [r[0] for r in rows]
    while True:
        new = [min((x for x in (root[i], *(root[j] for j in np.flatnonzero(near[i]))) if x is not None), default=None) for i in range(n)]
        if new == root:
            break
        root = new
    key = [(str(r[0]), int(near[i].sum()), str(root[i]), r[0] is not None and root[i] == r[0]) for i, r in enumerate(rows)]
    return sorted(key)


def awkward():
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)]
    base = rng.normal(size=8)
    rows += [(200 + i, (base + 0.2 * rng.normal(size=8)).tolist()) for i in range(40)]  # a dense group
    rows += [(300 + i, base.tolist()) for i in range(30)]  # one very common vector
    rows += [(400, (2 * base).tolist()), (401, (-base).tolist()), (402, rng.normal(size=5).tolist())]
    rows += [(403, None), (404, []), (405, [0.0] * 8), (406, [1.0, None] * 4), (407, [float("nan")] * 8)]
    rows += [(408, [float("inf")] + [0.0] * 7), (None, base.tolist()), (None, rng.normal(size=3).tolist()), (None, [0.0]), (409, [1e-30] * 8), (410, [1e30] * 8)]
    return [*rows, rows[3], rows[3]]


SCHEMA = "vec_id bigint, embedding array<float>, node string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def test_against_all_pairs(spark):
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in awkward()]
    for block in (C.BLOCK, 32):
        found = C.link_embeddings(frame(spark, rows), block=block).collect()
        got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in found)
        assert got == brute(rows)


def test_empty_table(spark):
    assert C.link_embeddings(frame(spark, [])).collect() == []


def test_trees_cover_their_points_and_lose_no_pair():
    rng = np.random.default_rng(1)
    for n, spread in ((1, 1.0), (2, 0.0), (300, 1.0), (300, 0.05), (700, 0.3)):
        points = rng.normal(size=(1, 6)) + spread * rng.normal(size=(n, 6))
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        tree = C.CoverTree(points)
        for level, centres in enumerate(tree.centres[:-1]):
            assert np.array_equal(tree.centres[level + 1][: len(centres)], centres) or level == len(tree.centres) - 2
            reach = C._distances(points, points[centres]).min(axis=1)
            assert reach.max() <= 2.0 ** (1 - level) + 1e-9
        found = {(i, j) for a, b in C.linked_pairs(tree, tree) for i, j in zip(a.tolist(), b.tolist())}
        assert found == set(zip(*(x.tolist() for x in np.nonzero(points @ points.T >= 0.9)))) | {(i, i) for i in range(n)}
