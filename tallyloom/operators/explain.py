"""Explaining a boosted-tree model: importance, permutation, partial dependence."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.expr import ratio
from tallyloom.functions.quantile import exact_quantiles
from tallyloom.operators.backtest import metrics
from tallyloom.operators.forecast import SEED, Scorer, boosted_scorer, with_vector
from tallyloom.session import ship_package

REPEATS = 8
GRID_POINTS = 9
#: Buckets of the circle of a repeat: 2 to the power of this, at any size.
BUCKET_BITS = 12
#: Rows that walk the trees together.
ROWS = 2048


def feature_importance(model: GBTRegressionModel, features: Sequence[str], spark, top_n: int | None = None) -> DataFrame:
    """Importance, share and rank of each feature; one row per feature, whatever the data."""
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    every = W.partitionBy(F.lit(0))
    out = (
        spark.createDataFrame(rows, "feature string, importance double")
        .withColumn("importance_share", ratio("importance", F.sum("importance").over(every)))
        .withColumn("rank", F.row_number().over(every.orderBy(F.col("importance").desc(), "feature")))
    )
    return out if top_n is None else out.filter(F.col("rank") <= top_n)


def grouped_importance(importance: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Features, share and strongest feature per group, over all features and not just the top ones."""
    names = {f: g for g, members in groups.items() for f in members}
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return (
        importance.withColumn("group", F.coalesce(F.try_element_at(mapping, F.col("feature")), F.lit("other")))
        .groupBy("group")
        .agg(
            F.count(F.lit(1)).alias("feature_count"),
            F.sum("importance_share").alias("importance_share"),
            F.min_by("feature", "rank").alias("top_feature"),
        )
    )


def _leaves(scorer: Scorer, trees: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The leaf that each row of x reaches in each of the trees."""
    rows = np.arange(len(x))[:, None]
    node = np.zeros((len(x), len(trees)), dtype=np.int64)
    for _ in range(scorer.depth):
        goes_left = x[rows, scorer.feature[trees, node]] <= scorer.threshold[trees, node]
        node = np.where(goes_left, scorer.left[trees, node], scorer.right[trees, node])
    return node


def _splits(scorer: Scorer) -> np.ndarray:
    """Where a node of a tree splits; a leaf points at itself."""
    return scorer.left != np.arange(scorer.left.shape[1])


def trees_by_feature(scorer: Scorer) -> list[np.ndarray]:
    """For each feature the trees that split on it: nothing else of a prediction depends on it."""
    splits = _splits(scorer)
    return [np.flatnonzero((splits & (scorer.feature == j)).any(axis=1)) for j in range(len(scorer.features))]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.flatten()).reshape(-1, width)


def _trial_errors(scorer: Scorer):
    """Squared errors of a batch of (_r, _x, _other, _y), summed up for each repeat and shuffled feature.

    The outputs of all trees are kept; a feature costs the walk of the trees in its list. Feature -1 is the
    error with nothing shuffled, which is also that of features no tree asks for.
    """
    index = trees_by_feature(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x, other = (_matrix(part.column(c), len(scorer.features)) for c in ("_x", "_other"))
                y, repeat = part.column("_y").to_numpy(), part.column("_r").to_numpy()
                every = np.arange(len(scorer.weights))
                own = scorer.value[every, _leaves(scorer, every, x)] * scorer.weights
                plain = own.sum(axis=1)
                repeats, at = np.unique(repeat, return_inverse=True)
                sums = {-1: np.bincount(at, (y - plain) ** 2)}
                for j, trees in enumerate(index):
                    if not len(trees):
                        sums[j] = sums[-1]
                        continue
                    kept = x[:, j].copy()
                    x[:, j] = other[:, j]
                    new = scorer.value[trees, _leaves(scorer, trees, x)] * scorer.weights[trees]
                    x[:, j] = kept
                    sums[j] = np.bincount(at, (y - (plain + (new - own[:, trees]).sum(axis=1))) ** 2)
                n = np.bincount(at)
                yield pa.RecordBatch.from_pydict(
                    {
                        "_f": pa.array(np.repeat(list(sums), len(repeats)), pa.int32()),
                        "_r": pa.array(np.tile(repeats, len(sums)), pa.int32()),
                        "_sum": pa.array(np.concatenate(list(sums.values()))),
                        "_n": pa.array(np.tile(n, len(sums)), pa.int64()),
                    }
                )

    return run


def shuffled_rows(holdout: DataFrame, features: Sequence[str], target: str, repeats: int, seed: int) -> DataFrame:
    """(_r, _x, _other, _y): each row once per repeat, with the row before it in the circle of the repeat.

    Rows stand in the order of a seeded hash. Positions in the circle are counted per bucket of the hash,
    whatever the number of rows, so no task orders them all.
    """
    order = F.array(*[F.col(f).cast("double") for f in features])
    base = holdout.select(F.col(target).cast("double").alias("_y"), order.alias("_x"))
    # A row number that does not depend on how the rows are spread: a hash of the row itself.
    base = base.withColumn("_id", F.xxhash64("_x", "_y"))
    trials = base.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    trials = trials.withColumn("_h", F.xxhash64("_id", "_r", F.lit(seed)))
    trials = trials.withColumn("_bucket", F.shiftrightunsigned("_h", 64 - BUCKET_BITS).cast("int"))
    counts = trials.groupBy("_r", "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    in_repeat = W.partitionBy("_r")
    until = F.sum("_c").over(in_repeat.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0))
    starts = counts.select("_r", "_bucket", (until - F.col("_c")).alias("_start"), F.sum("_c").over(in_repeat).alias("_n"))
    local = F.row_number().over(W.partitionBy("_r", "_bucket").orderBy("_h", "_id"))
    placed = trials.withColumn("_local", local).join(starts, ["_r", "_bucket"])
    placed = placed.withColumn("_place", F.col("_start") + F.col("_local") - 1).select("_r", "_place", "_n", "_x", "_y")
    donors = placed.select("_r", F.pmod(F.col("_place") + 1, F.col("_n")).alias("_place"), F.col("_x").alias("_other"))
    return placed.join(donors, ["_r", "_place"]).select("_r", "_x", "_other", "_y")


def permutation_importance(
    model: GBTRegressionModel, holdout: DataFrame, features: Sequence[str], target: str, repeats: int = REPEATS, seed: int = SEED
) -> DataFrame:
    """Rise of the error when one feature is shuffled, mean and deviation over the repeats.

    All features share the circle of a repeat, so a row travels once per repeat, with its whole array; it is
    never unfolded to features. Tasks hand on one sum per feature and repeat.
    """
    spark = holdout.sparkSession
    ship_package(spark)
    pairs = shuffled_rows(holdout, features, target, repeats, seed)
    sums = pairs.mapInArrow(_trial_errors(boosted_scorer(model, features, spark)), "_f int, _r int, _sum double, _n bigint")
    per_trial = sums.groupBy("_f", "_r").agg(F.sqrt(F.sum("_sum") / F.sum("_n")).alias("rmse"))
    plain = F.max(F.when(F.col("_f") < 0, F.col("rmse"))).over(W.partitionBy("_r"))
    names = F.array(*[F.lit(f) for f in features])
    out = (
        per_trial.withColumn("drop", F.col("rmse") - plain)
        .filter("_f >= 0")
        .groupBy("_f")
        .agg(F.avg("drop").alias("perm_importance_mean"), F.stddev_pop("drop").alias("perm_importance_std"))
        .select(F.element_at(names, F.col("_f") + 1).alias("feature"), "perm_importance_mean", "perm_importance_std")
    )
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("perm_importance_mean").desc(), "feature"))
    return out.withColumn("rank", rank)


def _reaching(scorer: Scorer, x: np.ndarray, j: int, trees: np.ndarray) -> np.ndarray:
    """How many rows reach each node of each tree when feature j is left free: its splits let rows go both ways."""
    size = scorer.left.shape[1]
    splits = _splits(scorer)
    counts = np.zeros((len(trees), size), dtype=np.int64)
    for k, tree in enumerate(trees):
        reach = {0: np.ones(len(x), dtype=bool)}
        todo = [0]
        while todo:
            node = todo.pop()
            here = reach.pop(node)
            counts[k, node] = here.sum()
            if splits[tree, node]:
                split = scorer.feature[tree, node]
                left = here if split == j else here & (x[:, split] <= scorer.threshold[tree, node])
                right = here if split == j else here & ~left
                for child, rows in ((scorer.left[tree, node], left), (scorer.right[tree, node], right)):
                    reach[int(child)] = rows
                    todo.append(int(child))
    return counts


def _leaf_counts(scorer: Scorer, which: Sequence[int]):
    index = trees_by_feature(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {j: np.zeros((len(index[j]), scorer.left.shape[1]), dtype=np.int64) for j in which}
        rest, rows = {j: 0.0 for j in which}, 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.slice(start, ROWS).column("_x"), len(scorer.features))
                rows += len(x)
                for j in which:
                    total[j] += _reaching(scorer, x, j, index[j])
                    others = np.setdiff1d(np.arange(len(scorer.weights)), index[j])
                    rest[j] += float((scorer.value[others, _leaves(scorer, others, x)] * scorer.weights[others]).sum())
        f, tree, node, n, value = [], [], [], [], []
        for j in which:
            k, at = np.nonzero(total[j])
            f += [j] * (len(k) + 1)
            tree += [*index[j][k].tolist(), -1]
            node += [*at.tolist(), -1]
            n += [*total[j][k, at].tolist(), rows]
            value += [0.0] * len(k) + [rest[j]]
        yield pa.RecordBatch.from_pydict(
            {"_f": pa.array(f, pa.int32()), "_tree": pa.array(tree, pa.int32()), "_node": pa.array(node, pa.int32()),
             "_n": pa.array(n, pa.int64()), "_rest": pa.array(value, pa.float64())}
        )

    return run


def partial_dependence(
    model: GBTRegressionModel, rows: DataFrame, features: Sequence[str], which: Sequence[str], points: int = GRID_POINTS
) -> DataFrame:
    """Mean prediction with one feature set to each of its quantiles from 5 to 95 percent.

    One pass counts the rows that reach each leaf with the feature left free; the mean for any value of the
    feature is then a sum over the leaves which that value leads to. Rows are not unfolded by grid points.
    """
    order = F.array(*[F.col(f).cast("double") for f in features])
    base = rows.select(order.alias("_x"))
    position = {f: list(features).index(f) for f in which}
    values = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.element_at("_x", i + 1).alias("v")) for f, i in position.items()]
    )
    probs = {f"q{k}": 0.05 + 0.9 * k / (points - 1) for k in range(points)}
    grid = exact_quantiles(base.select(F.inline(values)), ["feature"], "v", probs)
    spark = rows.sparkSession
    ship_package(spark)
    scorer = boosted_scorer(model, features, spark)
    counted = base.mapInArrow(
        _leaf_counts(scorer, sorted(position.values())), "_f int, _tree int, _node int, _n bigint, _rest double"
    )
    counted = counted.groupBy("_f", "_tree", "_node").agg(F.sum("_n").alias("n"), F.sum("_rest").alias("rest"))
    found = {j: [] for j in position.values()}
    for r in counted.collect():  # a row per node of the model at most
        found[r["_f"]].append(r)
    splits, out = _splits(scorer), []
    for line in grid.collect():
        j = position[line["feature"]]
        for k in range(points):
            at, total, n = line[f"q{k}"], 0.0, 1
            open_nodes = _nodes_for(scorer, splits, j, at)
            for r in found[j]:
                if r["_tree"] < 0:
                    total, n = total + r["rest"], r["n"]
                elif not splits[r["_tree"], r["_node"]] and open_nodes[r["_tree"], r["_node"]]:
                    total += scorer.weights[r["_tree"]] * scorer.value[r["_tree"], r["_node"]] * r["n"]
            out.append((line["feature"], k, at, float(total / n) if n else None))
    return spark.createDataFrame(out, "feature string, point int, grid_value double, avg_prediction double")


def _nodes_for(scorer: Scorer, splits: np.ndarray, j: int, value: float) -> np.ndarray:
    """Nodes that a row may reach when feature j has this value, whatever its other features."""
    open_ = np.zeros(splits.shape, dtype=bool)
    open_[:, 0] = True
    trees = np.arange(len(scorer.weights))
    for node in range(splits.shape[1]):  # a child has a higher number than its parent
        on = splits[:, node] & open_[:, node]
        left = on & ((scorer.feature[:, node] != j) | (value <= scorer.threshold[:, node]))
        right = on & ((scorer.feature[:, node] != j) | (value > scorer.threshold[:, node]))
        open_[trees[left], scorer.left[left, node]] = True
        open_[trees[right], scorer.right[right, node]] = True
    return open_


def holdout_summary(
    model: GBTRegressionModel, holdout: DataFrame, features: Sequence[str], target: str, kind: str = "one_step_ahead"
) -> DataFrame:
    """Metrics of the model on the holdout in long form.

    The features hold true lags, so these are one-step-ahead errors; they do not compare with those
    of a recursive backtest, and ``kind`` says so.
    """
    scored = model.transform(with_vector(holdout, features))
    row = metrics(scored, [], target, "prediction")
    lines = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mae", "rmse", "r2")])
    return row.select(F.lit(kind).alias("kind"), F.inline(lines))
