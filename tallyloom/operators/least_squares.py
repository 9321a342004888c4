"""Least squares from statistics that merge: one pass over the rows serves the models of all folds.

A block of rows is summed up in its row count, means and co-moments (sums of products around the means,
which do not cancel). Two blocks merge exactly, so with the rows blocked by the first fold that may train on
them, the model of a fold is solved from the blocks up to its own, and the model of all rows from all blocks.
The driver sees one small matrix per block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import ship_package

#: Tasks that add up the matrices of all others.
MERGERS = 8


@dataclass(frozen=True)
class Moments:
    """Number of rows, means and co-moments of some columns, the target last."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        apart = other.mean - self.mean
        return Moments(
            n,
            self.mean + apart * (other.n / n),
            self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n),
        )

    def solve(self) -> tuple[np.ndarray, float]:
        """Coefficients and intercept of the least squares fit; a column without variance gets 0."""
        spread = np.sqrt(np.diag(self.products)[:-1])
        usable = spread > 0
        scale = spread[usable]
        system = self.products[:-1, :-1][np.ix_(usable, usable)] / np.outer(scale, scale)
        right = self.products[:-1, -1][usable] / scale
        answer = np.zeros(len(spread))
        if usable.any():
            singular = np.linalg.matrix_rank(system, hermitian=True) < len(system)
            found = np.linalg.lstsq(system, right, rcond=None)[0] if singular else np.linalg.solve(system, right)
            answer[usable] = found / scale
        return answer, float(self.mean[-1] - answer @ self.mean[:-1])


def _of(x: np.ndarray) -> Moments:
    mean = x.mean(axis=0)
    return Moments(len(x), mean, (x - mean).T @ (x - mean))


def _batch(found: dict[int, Moments]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "block": pa.array(list(found), pa.int32()),
            "n": pa.array([float(m.n) for m in found.values()]),
            "mean": pa.array([m.mean.tolist() for m in found.values()], pa.list_(pa.float64())),
            "products": pa.array([m.products.ravel().tolist() for m in found.values()], pa.list_(pa.float64())),
        }
    )


def _read(rows) -> dict[int, Moments]:
    found: dict[int, Moments] = {}
    for r in rows:
        one = Moments(r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(len(r["mean"]), -1))
        found[r["block"]] = found[r["block"]] + one if r["block"] in found else one
    return found


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of what a task reads; the first column is the block."""
    found: dict[int, Moments] = {}
    for batch in batches:
        block, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        x = np.column_stack(columns).astype(float)
        for k in np.unique(block).tolist():
            one = _of(x[block == k])
            found[k] = found[k] + one if k in found else one
    yield _batch(found)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _batch(_read(r for batch in batches for r in batch.to_pylist()))


def moments(rows: DataFrame, columns: Sequence[str], block: Column) -> dict[int, Moments]:
    """``Moments`` of each block of rows (a whole number) without nulls, from one pass.

    A task hands on one matrix per block; ``MERGERS`` tasks add those up, so the driver gets a bounded number
    of them, however many tasks there are.
    """
    ship_package(rows.sparkSession)
    schema = "block int, n double, mean array<double>, products array<double>"
    read = rows.select(block.cast("int").alias("_block"), *[F.col(c).cast("double") for c in columns])
    return _read(read.mapInArrow(_sum_up, schema).repartition(MERGERS).mapInArrow(_merge, schema).collect())


def fold_block(last: Column, horizon: int, n_folds: int, date: str = "date") -> Column:
    """The first fold that may train on the day; ``n_folds + 1`` for days that none may."""
    age = F.datediff(last, F.col(date))
    return F.greatest(F.lit(1), F.lit(n_folds + 1) - F.floor(age / F.lit(horizon)).cast("int"))


def up_to(blocks: dict[int, Moments], fold: int) -> Moments:
    """What the folds up to this one may train on."""
    return reduce(Moments.__add__, [m for k, m in sorted(blocks.items()) if k <= fold])
