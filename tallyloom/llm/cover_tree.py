"""Near duplicates among embeddings by dual traversal of cover trees.

A cover tree holds nested sets of centres with halving radii; every vector lies within the covering
radius of its ancestors. Two nodes can be set aside, with all below them, when their centres are
farther apart than both covering radii and the wanted distance. What is left at the bottom is checked
in double precision, so the links are exact.

The top of the tree is built from a bounded sample (``SAMPLE``) and cuts the space into cells; cells are
dealt to blocks of bounded size, and pairs of blocks whose cells are not all set aside meet in a task,
which builds the trees of both and walks them together. Equal directions are one node from the start,
with the number of its vectors, so copies are counted and not compared.

Defined results: a vector that is null, empty, zero, or holds a null, NaN or infinite component links
with nothing and is its own component. So does a row without an id; its component is null. Only
vectors of equal length are compared. Rows that repeat an id count as separate vectors. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import components, table
from tallyloom.llm.local import Links
from tallyloom.session import ship_package, store

COSINE = 0.9
SAMPLE, CELLS, BLOCK = 2048, 64, 8192
LEVELS = 6
_SLACK = 1e-9


def _chord(cosine: float) -> float:
    return math.sqrt(2 - 2 * cosine)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _narrow(points: np.ndarray) -> np.ndarray:
    """Single precision, for choices that need not be exact and for tests with a margin."""
    return points.astype(np.float32)


def _nearest(points: np.ndarray, centres: np.ndarray, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every point, and its distance."""
    which, far = np.empty(len(points), dtype=np.int64), np.empty(len(points))
    for at in range(0, len(points), rows):
        d = _distances(points[at : at + rows], centres)
        which[at : at + rows] = d.argmin(axis=1)
        far[at : at + rows] = d.min(axis=1)
    return which, far


def widen(points: np.ndarray, net: list[int], radius: float, rows: int = 512) -> list[int]:
    """Centres, those of ``net`` first, such that every point is within about ``radius`` of one.

    Single precision is enough: covering radii are measured afterwards.
    """
    net = list(net)
    near = 1 - radius * radius / 2  # the cosine at that distance
    others = np.setdiff1d(np.arange(len(points)), net)
    for at in range(0, len(others), rows):
        here = others[at : at + rows]
        if net:
            here = here[(points[here] @ points[net].T).max(axis=1) < near]
        close = points[here] @ points[here].T >= near
        covered = np.zeros(len(here), dtype=bool)
        for i in range(len(here)):
            if not covered[i]:
                covered |= close[i]
                net.append(int(here[i]))
    return net


class CoverTree:
    """Levels of nodes; the last level has every point as a node of its own."""

    def __init__(self, points: np.ndarray):
        self.points, self.single = points, _narrow(points)
        nets: list[list[int]] = [[0]]
        for level in range(1, LEVELS):
            nets.append(widen(self.single, nets[-1], 2.0 ** (1 - level)))
            if len(nets[-1]) == len(points):
                break
        self.centres = [np.array(n) for n in nets]
        if len(nets[-1]) < len(points):
            rest = np.setdiff1d(np.arange(len(points)), nets[-1])
            self.centres.append(np.concatenate((self.centres[-1], rest)))
        # The centres of a level are the first ones of the next, and their own parents.
        self.children, parents = [], []
        for upper, lower in zip(self.centres, self.centres[1:]):
            parent = np.arange(len(lower))
            new = self.single[lower[len(upper) :]]
            for at in range(0, len(new), 1024):
                nearest = (new[at : at + 1024] @ self.single[upper].T).argmax(axis=1)
                parent[len(upper) + at : len(upper) + at + len(nearest)] = nearest
            order = np.argsort(parent, kind="stable")
            parents.append(parent)
            self.children.append((order, np.searchsorted(parent[order], np.arange(len(upper) + 1))))
        self.cover = [np.zeros(len(c)) for c in self.centres]
        ancestor = np.arange(len(self.centres[-1]))
        for level in range(len(self.centres) - 2, -1, -1):
            ancestor = parents[level][ancestor]
            away = points[self.centres[-1]] - points[self.centres[level][ancestor]]
            np.maximum.at(self.cover[level], ancestor, np.sqrt((away * away).sum(axis=1)))


def linked_pairs(a: CoverTree, b: CoverTree, cosine: float = COSINE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) with a cosine of at least ``cosine``, each pair once, in parts of bounded size.

    The shorter tree waits at its last level.
    """
    reach = _chord(cosine) + _SLACK
    last_a, last_b = len(a.centres) - 1, len(b.centres) - 1

    def below(tree: CoverTree, level: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        if level < last:
            return tree.children[level]
        n = len(tree.centres[level])
        return np.arange(n), np.arange(n + 1)

    def alive(i: np.ndarray, j: np.ndarray, d: np.ndarray, la: int, lb: int) -> np.ndarray:
        return d <= a.cover[la][i] + b.cover[lb][j] + reach

    def dense(ka: np.ndarray, kb: np.ndarray, na: int, nb: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in ka and kb of all pairs that stay alive, by products of whole matrices."""
        # Nodes of one point have no radius: their bound is one number, tested with a margin.
        flat = b.cover[nb][kb] == 0
        lone, wide = np.flatnonzero(flat), np.flatnonzero(~flat)
        right, near = b.single[b.centres[nb][kb[lone]]], cosine - 1e-4
        for at in range(0, len(ka), 512):
            part = np.arange(at, min(at + 512, len(ka)))
            alone = a.cover[na][ka[part]] == 0
            if len(lone) and alone.any():
                x, y = np.nonzero(a.single[a.centres[na][ka[part[alone]]]] @ right.T >= near)
                yield part[alone][x], lone[y]
            for mine, theirs in ((part, wide), (part[~alone], lone)):
                if len(mine) and len(theirs):
                    d = _distances(a.points[a.centres[na][ka[mine]]], b.points[b.centres[nb][kb[theirs]]])
                    x, y = np.nonzero(alive(ka[mine][:, None], kb[theirs][None, :], d, na, nb))
                    yield mine[x], theirs[y]

    def kids(nodes: np.ndarray, of: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of the nodes, and the place of the parent of each."""
        sizes = cut[nodes + 1] - cut[nodes]
        owner = np.repeat(np.arange(len(nodes)), sizes)
        offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return of[cut[nodes][owner] + offset], owner

    # Pairs of nodes still to be opened, deepest last.
    stack = [(0, 0, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        if la == last_a and lb == last_b:
            for at in range(0, len(i), 500_000):
                x, y = a.centres[la][i[at : at + 500_000]], b.centres[lb][j[at : at + 500_000]]
                near = np.einsum("ij,ij->i", a.points[x], b.points[y]) >= cosine
                yield x[near], y[near]
            continue
        (kids_a, cut_a), (kids_b, cut_b) = below(a, la, last_a), below(b, lb, last_b)
        na, nb = min(la + 1, last_a), min(lb + 1, last_b)
        many = (cut_a[i + 1] - cut_a[i]) * (cut_b[j + 1] - cut_b[j])
        (nodes_a, which_a), (nodes_b, which_b) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
        (ka, owner_a), (kb, owner_b) = kids(nodes_a, kids_a, cut_a), kids(nodes_b, kids_b, cut_b)
        if many.sum() * 8 >= len(ka) * len(kb):
            # Most pairs among these nodes are open: test all and drop those whose parents are not.
            opened = np.zeros((len(nodes_a), len(nodes_b)), dtype=bool)
            opened[which_a, which_b] = True
            for x, y in dense(ka, kb, na, nb):
                keep = opened[owner_a[x], owner_b[y]]
                if keep.any():
                    stack.append((na, nb, ka[x[keep]], kb[y[keep]]))
            continue
        ends, done = np.cumsum(many), 0
        while done < len(i):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + 500_000, "right")))
            pick = np.arange(done, stop)
            done = stop
            width = cut_b[j[pick] + 1] - cut_b[j[pick]]
            count = many[pick]
            of = np.repeat(pick, count)
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            wide_of = np.repeat(width, count)
            x = kids_a[cut_a[i[of]] + k // wide_of]
            y = kids_b[cut_b[j[of]] + k % wide_of]
            dot = np.einsum("ij,ij->i", a.points[a.centres[na][x]], b.points[b.centres[nb][y]])
            keep = alive(x, y, np.sqrt(np.maximum(2 - 2 * dot, 0)), na, nb)
            if keep.any():
                stack.append((na, nb, x[keep], y[keep]))


_UNITS = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("node", pa.string()), ("unit", pa.binary())])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for vec_id, values in zip(batch.column("vec_id").to_pylist(), batch.column("_vector").to_pylist()):
            vector = np.array(values, dtype=np.float64)
            vector /= np.abs(vector).max()  # squares neither overflow nor vanish
            unit = (vector / math.sqrt(vector @ vector) + 0.0).tobytes()
            out.append((vec_id, len(vector), hashlib.md5(unit).hexdigest(), unit))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _UNITS)], schema=_UNITS)


def _matrix(units, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype=np.float64).reshape(-1, dim)


def spread_centres(points: np.ndarray, most: int) -> np.ndarray:
    """Positions of centres, each the farthest from those before: the top levels of a tree."""
    chosen, far = [0], _distances(points, points[:1])[:, 0]
    while len(chosen) < min(most, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(points, points[chosen[-1:]])[:, 0])
    return np.array(chosen)


def _cells(centres: dict[int, bytes]):
    schema = pa.schema([("node", pa.string()), ("n", pa.int64()), ("unit", pa.binary()), ("dim", pa.int32()), ("cell", pa.int32()), ("away", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                which, away = _nearest(_matrix(part.column("unit").to_pylist(), dim), _matrix([centres[int(dim)]], dim))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("node", "n", "unit", "dim")), pa.array(which.astype(np.int32)), pa.array(away)],
                    schema=schema,
                )

    return run


def _blocks(stats: list[tuple[int, int, int, float]], centres: dict[int, bytes], cosine: float, block: int):
    """(dim, cell, first block, number of blocks, ranges of the blocks that it may link with) of each cell."""
    plan, opened = {}, 0
    room = 0
    for dim, cell, n, _ in sorted(stats):
        if n > block or n > room or not plan or dim != last_dim:
            parts = max(1, -(-n // block))
            plan[dim, cell] = (opened, parts)
            opened, room = opened + parts, (block - n if parts == 1 else 0)
        else:
            plan[dim, cell] = (opened - 1, 1)
            room -= n
        last_dim = dim
    rows = []
    for dim, cell, _, cover in stats:
        points = _matrix([centres[dim]], dim)
        others = [(c, r) for d, c, _, r in stats if d == dim]
        d = _distances(points[[cell]], points[[c for c, _ in others]])[0]
        ranges = sorted({plan[dim, c] for (c, r), apart in zip(others, d) if apart <= cover + r + _chord(cosine) + _SLACK})
        rows.append((dim, cell, *plan[dim, cell], [{"first": f, "parts": p} for f, p in ranges]))
    return rows


def _walk(cosine: float):
    schema = pa.schema([("node", pa.string()), ("links", pa.int64()), ("root", pa.string())])

    def met(rows: pa.Table) -> pa.RecordBatch:
        side, dim = rows.column("side").to_numpy(), rows.column("dim")[0].as_py()
        nodes, counts = np.array(rows.column("node").to_pylist(), dtype=object), rows.column("n").to_numpy()
        points = _matrix(rows.column("unit").to_pylist(), dim)
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links, stars = np.zeros(len(nodes), dtype=np.int64), Links(len(nodes))
        tree = CoverTree(points[first]) if len(first) else None
        other = CoverTree(points[second]) if len(second) else tree
        if tree and other:
            to = second if len(second) else first
            for i, j in linked_pairs(tree, other, cosine):
                i, j = first[i], to[j]
                i, j = i[i != j], j[i != j]
                links += np.bincount(i, counts[j], len(nodes)).astype(np.int64)
                if len(second):
                    links += np.bincount(j, counts[i], len(nodes)).astype(np.int64)
                stars.add(i, j)
        moved, root = stars.stars()
        roots = np.arange(len(nodes))
        roots[moved] = root
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[some], pa.string()), pa.array(links[some]), pa.array(nodes[roots[some]], pa.string())], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
            change = np.flatnonzero((np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            for start, stop in zip([0, *change], [*change, len(lo)]):
                if held and (lo[start], hi[start]) != key:
                    yield met(pa.Table.from_batches(held))
                    held = []
                key = (lo[start], hi[start])
                held.append(batch.slice(start, stop - start))
        if held:
            yield met(pa.Table.from_batches(held))

    return run


def link_embeddings(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    ship_package(spark)
    all_rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_vector"))
    odd = F.exists("_vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(~odd & F.exists("_vector", lambda x: x != 0), F.lit(False))
    units = all_rows.filter(sound).mapInArrow(_units, "vec_id bigint, dim int, node string, unit binary")
    units = store(units, "units")
    classes = units.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("unit").alias("unit"), F.first("dim").alias("dim")
    )
    classes = store(classes, "directions")
    per_dim = {r["dim"] for r in classes.select("dim").distinct().collect()}
    centres = {}
    for dim in per_dim:
        # Names are digests, so the first ones are a sample; its size does not depend on the corpus.
        sample = [r["unit"] for r in classes.filter(F.col("dim") == dim).orderBy("node").limit(SAMPLE).select("unit").collect()]
        points = _matrix(sample, dim)
        centres[dim] = points[spread_centres(points, CELLS)].tobytes()
    celled = store(
        classes.select("node", "n", "unit", "dim").mapInArrow(
            _cells(centres), "node string, n bigint, unit binary, dim int, cell int, away double"
        ),
        "cells",
    )
    stats = celled.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("cover")).collect()
    plan = _blocks([tuple(r) for r in stats], centres, cosine, block)
    # One row per cell, at most CELLS for each length of vectors.
    frame = spark.createDataFrame(
        plan, "dim int, cell int, first bigint, parts bigint, others array<struct<first:bigint,parts:bigint>>"
    )
    own = (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).alias("own")
    dealt = celled.join(F.broadcast(frame), ["dim", "cell"]).select(
        "node", "n", "unit", "dim", own, F.explode("others").alias("range")
    )
    dealt = dealt.withColumn("other", F.explode(F.sequence("range.first", F.col("range.first") + F.col("range.parts") - 1)))
    pairs = dealt.select(
        F.least("own", "other").alias("lo"),
        F.greatest("own", "other").alias("hi"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "node", "n", "unit", "dim",
    )
    pairs = pairs.repartition("lo", "hi").sortWithinPartitions("lo", "hi")
    walked = store(pairs.mapInArrow(_walk(cosine), "node string, links bigint, root string"), "walked")
    roots = components(walked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = walked.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = classes.select("node", "n", "least").join(links, "node", "left").join(roots, "node", "left")
    rooted = rooted.select("node", "n", "least", "links", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    n_links = (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    # Written, so that the rows of a hot direction can be split in the join.
    per_class = store(rooted.join(least, "root").select("node", n_links, "component_id"), "direction-links")
    found = units.join(per_class, "node").select("vec_id", "n_links", "component_id")
    alone = all_rows.filter(~sound).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = found.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8(spark: SparkSession, directory: str) -> DataFrame:
    return link_embeddings(table(spark, directory, "embeddings"))


QUERIES = {"op8_cover_tree_links": op8}
