"""Gradient-boosted trees over a short frame: a whole model grows in one task.

``pyspark.ml`` runs several jobs for each level of each tree. Daily series have some thousand rows, whatever the
number of order lines, so these jobs are thousands and have next to nothing to do. A task grows the same trees
here: at most ``BINS`` bins a feature, gains of variance, level by level, squared loss, rows drawn for each tree
by ``rand``. Models of a comparison are jobs of one task and run side by side.

A test holds trees and importances against ``GBTRegressor``. Frames of more than ``MOST_ROWS`` rows, where
``pyspark.ml`` begins to sample for its bins, and models without rows are left to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import ship_package

MOST_ROWS = 10_000
BINS = 64
#: Parameters that a task grows by, with the defaults of ``GBTRegressor``.
DEFAULTS = {"maxIter": 20, "stepSize": 0.1, "maxDepth": 5, "subsamplingRate": 1.0, "minInstancesPerNode": 1}

_NODES = "feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, gain array<double>, n array<double>"


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Upper ends of the bins: between any two values, or where they part the rows most evenly."""
    values, counts = np.unique(x, return_counts=True)
    between, seen = (values[:-1] + values[1:]) / 2, np.cumsum(counts)
    if len(between) < bins:
        return between
    stride, out = len(x) / bins, []
    target = stride
    for i in range(1, len(values)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


def _variance(n, s, q):
    return np.where(n > 0, (q - s * s / n) / n, 0.0)


def _best_splits(stats: list[np.ndarray], parents: np.ndarray, sizes: np.ndarray, top: bool, p: dict) -> tuple:
    """Gain, feature, bin and both parts (n, sum, sum of squares) of the best split of every node of a level.

    ``stats`` are n, sums and sums of squares as (nodes, features, bins).
    """
    upto = [np.cumsum(a, axis=2) for a in stats]
    left = np.stack([a[:, :, :-1] for a in upto])
    right = np.stack([a[:, :, -1:] for a in upto]) - left
    if top:
        first = int(np.argmax(sizes > 0))
        parents = (left + right)[:, :, first, 0].T
    whole = _variance(*parents.T)[:, None, None]
    n = left[0] + right[0]
    gain = whole - left[0] / n * _variance(*left) - right[0] / n * _variance(*right)
    fits = (left[0] >= p["minInstancesPerNode"]) & (right[0] >= p["minInstancesPerNode"])
    fits &= (np.arange(left.shape[3]) < sizes[:, None])[None] & (gain >= 0)
    gain = np.where(fits, gain, -np.inf).reshape(len(parents), -1)
    at = gain.argmax(axis=1)
    nodes = np.arange(len(parents))
    feature, cut = np.divmod(at, left.shape[3])
    return gain[nodes, at], feature, cut, left[:, nodes, feature, cut].T, right[:, nodes, feature, cut].T, parents


def _grown(bins: np.ndarray, sizes: np.ndarray, y: np.ndarray, drawn: np.ndarray, p: dict) -> tuple[list, np.ndarray]:
    """One tree as a list of nodes, and the node of every row, drawn or not."""
    features, rows = bins.shape
    width = int(sizes.max(initial=0)) + 1
    here, target = bins[:, drawn], y[drawn]
    root = [np.array([float(len(target)), *(np.bincount(np.zeros(len(target), int), w, 1)[0] for w in (target, target * target))])]
    nodes = [{"stats": root[0], "left": -1, "right": -1}]
    place, level = np.zeros(rows, dtype=np.int64), [0]
    for depth in range(p["maxDepth"]):
        if not level or width == 1:
            break
        slot = np.full(len(nodes), -1)
        slot[level] = np.arange(len(level))
        of_row = slot[place[drawn]]
        inside = of_row >= 0
        key = (of_row[inside] * features + np.arange(features)[:, None]) * width + here[:, inside]
        shape, weights = (len(level), features, width), target[inside]
        stats = [
            np.bincount(key.ravel(), None if w is None else np.tile(w, features), int(np.prod(shape))).reshape(shape).astype(float)
            for w in (None, weights, weights * weights)
        ]
        known = np.stack([nodes[k]["stats"] for k in level])
        gain, feature, cut, left, right, known = _best_splits(stats, known, sizes, depth == 0, p)
        following = []
        for i, k in enumerate(level):
            nodes[k]["stats"] = known[i]
            if gain[i] <= 0:
                continue
            nodes[k] |= {"gain": gain[i], "feature": int(feature[i]), "cut": int(cut[i]), "left": len(nodes), "right": len(nodes) + 1}
            at = place == k
            low = bins[feature[i]] <= cut[i]
            place[at & low], place[at & ~low] = len(nodes), len(nodes) + 1
            for part in (left[i], right[i]):
                if abs(float(_variance(*part))) >= np.finfo(float).eps:
                    following.append(len(nodes))
                nodes.append({"stats": part, "left": -1, "right": -1})
        level = following
    for node in nodes:
        n, s, _ = node["stats"]
        node["value"] = s / n if n else 0.0
    return nodes, place


def _arrays(nodes: list, edges: Sequence[np.ndarray]) -> dict:
    """The nodes in the order root, left part, right part; two leaves of one value are one, a leaf points at itself."""
    out = {name: [] for name in ("feature", "threshold", "left", "right", "value", "gain", "n")}

    def leaf(k: int) -> bool:
        node = nodes[k]
        if node["left"] >= 0:
            low, high = leaf(node["left"]), leaf(node["right"])
            if low and high and nodes[node["left"]]["value"] == nodes[node["right"]]["value"]:
                node["left"] = node["right"] = -1
        return node["left"] < 0

    def add(k: int) -> int:
        node, at = nodes[k], len(out["value"])
        split = node["left"] >= 0
        for name, value in (
            ("feature", node["feature"] if split else 0), ("left", at), ("right", at), ("value", node["value"]),
            ("threshold", edges[node["feature"]][node["cut"]] if split else np.inf), ("gain", node["gain"] if split else 0.0),
            ("n", node["stats"][0]),
        ):
            out[name].append(value)
        if split:
            out["left"][at] = add(node["left"])
            out["right"][at] = add(node["right"])
        return at

    leaf(0)
    add(0)
    return out


def grow(x: np.ndarray, y: np.ndarray, drawn: np.ndarray, p: dict) -> Iterator[dict]:
    """The trees of one model as node arrays; ``drawn`` says for each row and tree whether it takes part."""
    edges = [cuts(column, min(BINS, len(x))) for column in x.T]
    bins = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)])
    sizes = np.array([len(e) for e in edges])
    total, goal = np.zeros(len(y)), y
    with np.errstate(divide="ignore", invalid="ignore"):
        for tree in range(p["maxIter"]):
            nodes, place = _grown(bins, sizes, goal, drawn[:, tree], p)
            total = total + np.array([node["value"] for node in nodes])[place] * (p["stepSize"] if tree else 1.0)
            goal = 2.0 * (y - total)
            yield _arrays(nodes, edges)


def _in_task(p: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = sum(b.num_rows for b in parts)
        x, y, drawn = (np.concatenate([b.column(c).flatten().to_numpy(zero_copy_only=False) for b in parts]) for c in ("_x", "_y", "_drawn"))
        trees = list(grow(x.reshape(rows, -1), y, drawn.reshape(rows, -1).astype(bool), p))
        types = {"feature": pa.int32(), "left": pa.int32(), "right": pa.int32()}
        yield pa.RecordBatch.from_pydict(
            {"tree": pa.array(range(len(trees)), pa.int32())}
            | {name: pa.array([t[name] for t in trees], pa.list_(types.get(name, pa.float64()))) for name in trees[0]}
        )

    return run


def fit(frame: DataFrame, params: dict, seed: int) -> tuple[dict[str, np.ndarray], int, np.ndarray]:
    """Node arrays of all trees, their depth, and the importances of the features, from a frame (features, label)."""
    ship_package(frame.sparkSession)
    p = DEFAULTS | params
    drawn = F.array(*[F.rand(seed + 1 + tree) < p["subsamplingRate"] for tree in range(p["maxIter"])])
    rows = frame.coalesce(1).select(vector_to_array("features").alias("_x"), F.array(F.col("label").cast("double")).alias("_y"), drawn.alias("_drawn"))
    trees = sorted(rows.mapInArrow(_in_task(p), f"tree int, {_NODES}").collect(), key=lambda r: r["tree"])
    shape = (len(trees), max(len(t["value"]) for t in trees))
    kinds = {"feature": np.int64, "threshold": float, "left": np.int64, "right": np.int64, "value": float}
    out = {name: np.zeros(shape, dtype=kind) for name, kind in kinds.items()}
    width = len(frame.select("features").first()[0])
    importance, depth = np.zeros(width), 0
    for i, t in enumerate(trees):
        size = len(t["value"])
        for name, filled in out.items():
            filled[i, :size] = t[name]
        below = np.zeros(size, dtype=np.int64)
        for k in range(size):
            if t["left"][k] != k:
                importance[t["feature"][k]] += t["gain"][k] * t["n"][k]
                below[[t["left"][k], t["right"][k]]] = below[k] + 1
        depth = max(depth, int(below.max()))
    return out, depth, importance / importance.sum() if importance.sum() else importance
