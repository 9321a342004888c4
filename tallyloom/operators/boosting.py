"""Leaf-wise gradient boosting over histograms, all models of a comparison in the same jobs.

Features are cut once into bins of one byte and stay with the executors. A job sums gradients and row counts
per bin of the leaves that are wanted, inside the partitions first and then by a tree of sums, so that what
reaches the driver depends on leaves, features and bins and never on rows. Of two siblings only the smaller is
summed up, the other is its parent less the smaller.

The leaf of the greatest gain is split first, until a tree has its leaves. Which leaves that will be is known
only when their gains are, so a job opens every leaf that would be split as far as gains are known; the order
is then played through again. A tree so costs about as many jobs as it is deep, and is the tree that one split
at a time would give. Models of other targets, rows (folds, holdouts) or parameters ask for their histograms in
the same jobs. Where all rows fit one block there is nothing to merge, and each model grows in a task.

Loss is the squared error. Defined results: a row whose target is null is no row of that model; features must
not be null. A model without rows, or whose rows cannot be split, predicts its mean, or 0. Equal gains go to the
smaller feature, then the smaller bin; equal leaves to the left one.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.forecast import SEED, Scorer
from tallyloom.session import scratch_root, ship_package, store

#: Bins of a feature, and the part of all rows by which a bin may miss its quantile.
BINS, RANK_ERROR = 128, 0.001
#: Trees that tasks add up for each row anew; then the sums are kept with the rows.
KEEP = 10
#: Rows that one task sums up; a frame of no more is one block.
BLOCK_ROWS = 50_000
#: Kept sums after which the chain of them is cut in the checkpoint folder.
CUT = 5


@dataclass(frozen=True)
class LeafWise:
    """Parameters of a model; ``l1`` and ``l2`` weigh the leaf values, shares are drawn anew for each tree."""

    trees: int
    step: float
    leaves: int = 31
    min_rows: int = 20
    row_share: float = 1.0
    column_share: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    seed: int = SEED


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of numbers under a salt (additions, shifts and odd factors)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def drawn_rows(ids: np.ndarray, p: LeafWise, tree: int) -> np.ndarray:
    """Whether each row takes part in a tree; the id of a row decides, wherever it lies."""
    if p.row_share >= 1.0:
        return np.ones(len(ids), dtype=bool)
    return mixed(ids, p.seed + 2 * tree) < np.uint64(int(p.row_share * 2.0**64))


def drawn_columns(features: int, p: LeafWise, tree: int) -> np.ndarray:
    """The features that a tree may split on, ascending."""
    number = max(1, round(features * p.column_share))
    return np.sort(np.argsort(mixed(np.arange(features), p.seed + 2 * tree + 1), kind="stable")[:number])


def shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _gain_part(g, n, p: LeafWise):
    return shrunk(g, p.l1) ** 2 / np.maximum(n + p.l2, 1e-300)


@dataclass
class Tree:
    """Node arrays in bins; a leaf points at itself."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        rows, node = np.arange(bins.shape[1]), np.zeros(bins.shape[1], dtype=np.int32)
        for _ in range(self.depth):
            node = np.where(bins[self.feature[node], rows] <= self.bin[node], self.left[node], self.right[node])
        return node


@dataclass
class _Node:
    path: str
    g: float = 0.0
    n: float = 0.0
    sums: np.ndarray | None = None  # (columns, bins, 2): gradients and rows
    gain: float = 0.0
    split: tuple[int, int] = (0, 0)  # feature, last bin of the left part
    left: int = -1
    right: int = -1


@dataclass
class _Growing:
    """One model on the driver: its trees so far and the nodes of the next one."""

    params: LeafWise
    features: int
    done: list[Tree] = field(default_factory=list)
    recent: list[Tree] = field(default_factory=list)
    nodes: list[_Node] = field(default_factory=list)
    asked: list[tuple[int, int]] = field(default_factory=list)  # node to sum up, sibling to get by subtraction

    def start(self) -> None:
        self.columns = drawn_columns(self.features, self.params, len(self.done))
        self.nodes, self.asked = [_Node("")], [(0, -1)]

    @property
    def finished(self) -> bool:
        return len(self.done) >= self.params.trees

    def opened(self) -> Tree:
        """The nodes so far as a tree, to find the node of a row."""
        return self._tree(range(len(self.nodes)), lambda k: self.nodes[k].left >= 0)

    def _tree(self, kept, splits) -> Tree:
        kept = list(kept)
        at = {k: i for i, k in enumerate(kept)}
        size = len(kept)
        feature, cut, value = np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size)
        left, right, depth = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32), 0
        for k, i in at.items():
            node = self.nodes[k]
            if splits(k):
                feature[i], cut[i] = node.split
                left[i], right[i] = at[node.left], at[node.right]
                depth = max(depth, len(node.path) + 1)
            elif node.n:
                value[i] = -float(shrunk(node.g, self.params.l1)) / (node.n + self.params.l2)
        return Tree(feature, cut, left, right, value, depth)

    def take(self, answers: Mapping[int, np.ndarray]) -> None:
        """Fill in the sums that were asked for and find the best split of each node."""
        for k, sibling in self.asked:
            self._filled(k, answers[k])
            if sibling >= 0:
                parent = next(p for p in self.nodes if p.left in (k, sibling))
                self._filled(sibling, parent.sums - answers[k])
        self.asked = []

    def _filled(self, k: int, sums: np.ndarray) -> None:
        node, p = self.nodes[k], self.params
        node.sums = sums
        node.g, node.n = (float(v) for v in sums[0].sum(axis=0))
        below = np.cumsum(sums, axis=1)[:, :-1]
        g, n = below[..., 0], below[..., 1]
        gain = _gain_part(g, n, p) + _gain_part(node.g - g, node.n - n, p) - _gain_part(node.g, node.n, p)
        gain = np.where((n >= p.min_rows) & (node.n - n >= p.min_rows), gain, -np.inf)
        if gain.size:
            best = int(gain.argmax())
            column, cut = divmod(best, gain.shape[1])
            node.gain, node.split = float(gain.flat[best]), (int(self.columns[column]), cut)

    def proceed(self) -> None:
        """Play the order of splits through; ask for what is not known, or end the tree."""
        chosen, unknown, leaves = set(), [], 1
        heap = [(-self.nodes[0].gain, "", 0)]
        while heap and leaves < self.params.leaves:
            gain, _, k = heapq.heappop(heap)
            if gain >= 0.0:
                break
            node, leaves = self.nodes[k], leaves + 1
            if node.left < 0:
                unknown.append(k)
                continue
            chosen.add(k)
            for child in (node.left, node.right):
                heapq.heappush(heap, (-self.nodes[child].gain, self.nodes[child].path, child))
        for k in unknown:
            self._open(k)
        if self.asked:
            return
        if unknown:  # all of them opened into parts too small to be split again
            self.proceed()
            return
        kept = [k for k in range(len(self.nodes)) if k == 0 or self._parent_in(k, chosen)]
        tree = self._tree(kept, lambda k: k in chosen)
        self.done.append(tree)
        self.recent.append(tree)
        if not self.finished:
            self.start()

    def _parent_in(self, k: int, chosen: set[int]) -> bool:
        """Whether all splits above a node are chosen; a chosen node's parent always is."""
        return any(k in (self.nodes[p].left, self.nodes[p].right) for p in chosen)

    def _open(self, k: int) -> None:
        node = self.nodes[k]
        feature, cut = node.split
        column = int(np.searchsorted(self.columns, feature))
        g, n = node.sums[column, : cut + 1].sum(axis=0)
        parts = ((float(g), float(n)), (node.g - float(g), node.n - float(n)))
        node.left, node.right = len(self.nodes), len(self.nodes) + 1
        self.nodes += [_Node(node.path + side, *part) for side, part in zip("01", parts)]
        if max(parts[0][1], parts[1][1]) >= 2 * self.params.min_rows:
            small, large = (node.left, node.right) if parts[0][1] <= parts[1][1] else (node.right, node.left)
            self.asked.append((small, large))


# In tasks --------------------------------------------------------------------------------------


def _binned(edges: list[np.ndarray], models: int):
    """Batches as blocks of bytes: bins by feature, targets by model, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.asarray(batch.column("_x").flatten(), dtype=float).reshape(n, len(edges))
            bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]).astype(np.uint8)
            y = batch.column("_y").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, models).T
            ids = batch.column("_id").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_pydict(
                {"n": [n], "bins": [bins.tobytes()], "y": [np.ascontiguousarray(y).tobytes()], "ids": [ids.tobytes()]}
            )

    return run


def _block(row, features: int, start: Sequence[float]) -> tuple:
    y = np.frombuffer(row.y, dtype=float).reshape(len(start), row.n)
    bins = np.frombuffer(row.bins, dtype=np.uint8).reshape(features, row.n)
    return bins, y, np.frombuffer(row.ids, dtype=np.uint64), np.repeat(np.asarray(start)[:, None], row.n, axis=1)


def _kept(block: tuple, recent: Sequence[Sequence[Tree]], steps: Sequence[float]) -> tuple:
    """The block with the newest trees added to its predictions."""
    bins, y, ids, sums = block
    sums = sums.copy()
    for m, trees in enumerate(recent):
        for tree in trees:
            sums[m] += steps[m] * tree.value[tree.leaves_of(bins)]
    return bins, y, ids, sums


def _sums(block: tuple, work: Sequence[tuple]) -> dict:
    """Gradients and rows per bin of every wanted node: {(model, node): (columns, bins, 2)}."""
    bins, y, ids, kept = block
    out = {}
    for m, p, number, recent, opened, columns, wanted in work:
        rows = np.flatnonzero(~np.isnan(y[m]) & drawn_rows(ids, p, number))
        here = bins[:, rows]
        gradient = kept[m, rows] - y[m, rows]
        for tree in recent:
            gradient = gradient + p.step * tree.value[tree.leaves_of(here)]
        slot = np.full(len(opened.value), -1, dtype=np.int64)
        slot[wanted] = np.arange(len(wanted))
        slot = slot[opened.leaves_of(here)]
        inside = slot >= 0
        slot, gradient, here = slot[inside], gradient[inside], here[np.ix_(columns, inside)]
        shape = (len(wanted), len(columns), BINS)
        key = (slot[None, :] * len(columns) + np.arange(len(columns))[:, None]) * BINS + here
        size = int(np.prod(shape))
        g = np.bincount(key.ravel(), np.tile(gradient, len(columns)), size).reshape(shape)
        n = np.bincount(key.ravel(), minlength=size).reshape(shape)
        out.update({(m, k): np.stack([g[i], n[i]], axis=-1) for i, k in enumerate(wanted)})
    return out


def _merged(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in {**a, **b}}


# Fitting ---------------------------------------------------------------------------------------


def bin_edges(rows: DataFrame, features: Sequence[str], error: float = RANK_ERROR) -> list[np.ndarray]:
    """Upper ends of the bins: quantiles of all rows from mergeable sketches, one pass for all features."""
    found = rows.select(*[F.col(c).cast("double") for c in features]).approxQuantile(
        list(features), [k / BINS for k in range(1, BINS)], error
    )
    return [np.unique(np.asarray(q, dtype=float)) for q in found]


def _grow(growing: Sequence[_Growing], summed: Callable, renew: Callable, keep: int) -> None:
    """Grow all trees of all models; ``summed`` answers their wishes, ``renew`` adds trees to the kept sums."""
    for model in growing:
        if not model.finished:
            model.start()
    while any(not model.finished for model in growing):
        if max(len(model.recent) for model in growing) >= keep:
            renew([model.recent for model in growing])
            for model in growing:
                model.recent = []
        work = [
            (m, g.params, len(g.done), g.recent, g.opened(), g.columns, [k for k, _ in g.asked])
            for m, g in enumerate(growing)
            if not g.finished
        ]
        answers = summed(work)
        for m, model in enumerate(growing):
            if not model.finished:
                none = np.zeros((len(model.columns), BINS, 2))
                model.take({k: answers.get((m, k), none) for k, _ in model.asked})
                model.proceed()


def _grow_apart(blocks: RDD, growing: Sequence[_Growing]) -> None:
    """Rows of many blocks: every round of sums is a job over all of them."""
    steps, held, renewed = [g.params.step for g in growing], [blocks.persist(StorageLevel.MEMORY_AND_DISK)], [0]

    def summed(work: list) -> dict:
        return held[0].map(lambda block: _sums(block, work)).treeReduce(_merged)

    def renew(recent: list) -> None:
        older = held[0]
        held[0] = older.map(lambda block: _kept(block, recent, steps)).persist(StorageLevel.MEMORY_AND_DISK)
        renewed[0] += 1
        if renewed[0] % CUT == 0:
            held[0].checkpoint()
        held[0].count()
        older.unpersist()

    _grow(growing, summed, renew, KEEP)
    held[0].unpersist()


def _grow_in_place(blocks: RDD, growing: Sequence[_Growing]) -> None:
    """Rows of one block have nothing to merge: every model grows in a task of its own, by the same steps."""

    def grown(named: tuple) -> tuple:
        m, (model, held) = named[0], (growing[named[0]], list(named[1]))

        def renew(recent: list) -> None:
            held[:] = [_kept(block, recent, [model.params.step]) for block in held]

        _grow([model], lambda work: reduce(_merged, (_sums(block, work) for block in held)), renew, 1)
        return m, model.done

    def by_model(block: tuple) -> list:
        bins, y, ids, kept = block
        return [(m, (bins, y[m : m + 1], ids, kept[m : m + 1])) for m in range(len(y))]

    for m, trees in blocks.flatMap(by_model).groupByKey(len(growing)).map(grown).collect():
        growing[m].done = trees


def fit(
    rows: DataFrame, features: Sequence[str], models: Mapping[str, tuple[Column, LeafWise]], block_rows: int = BLOCK_ROWS
) -> dict[str, Scorer]:
    """Fit the named models, each a target column (null: not a row of the model) with its parameters."""
    spark = rows.sparkSession
    ship_package(spark)
    scratch_root(spark)
    values = [F.col(c).cast("double") for c in features]
    targets = [y.cast("double") for y, _ in models.values()]
    columns = [f"f{j}" for j in range(len(features))]
    frame = store(
        rows.select(
            *[v.alias(c) for c, v in zip(columns, values)],
            F.array(*targets).alias("_y"), F.xxhash64(*values, *targets).alias("_id"),
        ),
        "boosting-rows",
    )
    edges = bin_edges(frame, columns)
    number, *means = frame.agg(F.count(F.lit(1)), *[F.avg(F.col("_y")[m]) for m in range(len(models))]).first()
    start = [float(v or 0.0) for v in means]
    blocks = (
        frame.select(F.array(*columns).alias("_x"), "_y", "_id")
        .coalesce(max(1, number // block_rows))
        .mapInArrow(_binned(edges, len(models)), "n bigint, bins binary, y binary, ids binary")
        .rdd.map(lambda row: _block(row, len(columns), start))
    )
    growing = [_Growing(p, len(columns)) for _, p in models.values()]
    (_grow_in_place if number <= block_rows else _grow_apart)(blocks, growing)
    return {n: _scorer(features, edges, s, g) for n, s, g in zip(models, start, growing)}


def _scorer(features: Sequence[str], edges: list[np.ndarray], start: float, model: _Growing) -> Scorer:
    """All trees as node arrays over feature values; the mean is a tree of one leaf."""
    first = Tree(*(np.zeros(1, np.int32) for _ in range(4)), np.array([start]), 0)
    trees = [first, *model.done]
    size = max(len(t.value) for t in trees)
    shape = (len(trees), size)
    feature, threshold, value = np.zeros(shape, dtype=np.int64), np.full(shape, np.inf), np.zeros(shape)
    left, right = (np.tile(np.arange(size), (len(trees), 1)) for _ in range(2))  # what is not there is a leaf
    for i, t in enumerate(trees):
        n = len(t.value)
        feature[i, :n], left[i, :n], right[i, :n], value[i, :n] = t.feature, t.left, t.right, t.value
        for k in np.flatnonzero(t.left != np.arange(n)):
            threshold[i, k] = edges[t.feature[k]][t.bin[k]]
    weights = np.array([1.0] + [model.params.step] * len(model.done))
    return Scorer(
        tuple(features), weights=weights, feature=feature, threshold=threshold, left=left, right=right, value=value,
        depth=max(t.depth for t in trees),
    )


def _score(scorer: Scorer) -> Callable:
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(scorer.predict_many(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

    return run


def predicted(df: DataFrame, scorers: Mapping[str, Scorer]) -> DataFrame:
    """``df`` with one more column per model, scored in Arrow batches."""
    ship_package(df.sparkSession)
    vectors = {n: F.array(*[F.col(c).cast("double") for c in s.features]) for n, s in scorers.items()}
    return df.select("*", *[_score(s)(vectors[n]).alias(n) for n, s in scorers.items()])
