"""Near duplicates by SimHash, compared exactly in tiles.

Fingerprints whose bits differ in at most r places differ by at most r in the number of set bits, and
so do, summed up, the numbers of set bits of their halves. Distinct fingerprints are dealt to tiles by
the set bits of their halves; only tiles that can hold a pair are compared. Inside a task the same
bound, on each byte, skips pairs of smaller tiles before exclusive-or and bit count look at the rest.

A fingerprint has one or more 64-bit words. With one word, two are linked within ``radius`` bits.
More words estimate the similarity of the shingles; then the first word must be within ``first`` bits,
which the tiles are dealt by, the first two within ``second``, and all words together within ``radius``.
``SIMILAR`` links by such an estimate alone: half of the pairs at a similarity of 0.74, 96 of 100 at 0.8,
and one in a thousand at 0.62.

The stage that drops near copies links as the query does: ``STRICT``, three words and at most three bits.

Equal fingerprints are one node from the start, so a group of copies of any size is one row in the
comparison, and linked nodes leave a task as stars.

Defined results: null text counts as empty; a text without words has fingerprint 0 and is linked
like any other. Rows that repeat an id are returned as often as they occur. Null ids do not count for
the smallest id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import binary_text, components, slices, table
from tallyloom.llm.local import Links
from tallyloom.session import ship_package, store

SEED = 42
#: Fingerprints of one tile at most; a task compares two tiles. Smaller tiles inside a task.
TILE, SUBTILE = 1 << 17, 256
_BYTES = np.uint64(0x0101010101010101)


@dataclass(frozen=True)
class Measure:
    """How fingerprints are made and when two of them are linked."""

    width: int = 3
    words: int = 1
    radius: int = 3
    first: int | None = None
    second: int | None = None

    @property
    def near(self) -> int:
        return self.radius if self.first is None else self.first


STRICT = Measure()
SIMILAR = Measure(width=5, words=8, radius=92, first=19)


def shingle_hashes(text: bytes, width: int = 3, seed: int = SEED) -> bytes:
    """The hashes of all shingles, 8 big-endian bytes each."""
    digest = xxhash.xxh64_digest
    words = text.lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= width:
        return digest(joined, seed)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-width]]
    return b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :])])


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Other 64 bits of each hash, for the further words of a fingerprint; word 0 is the hash itself."""
    if not word:
        return hashes
    x = hashes + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority_bits(hashes: list[bytes], words: int = 1) -> np.ndarray:
    """The fingerprint (a row of words) of each list of hashes: the bits set in over half of them.

    Eight counters share a word: one bit of each byte is added up over runs of at most 255 hashes.
    """
    sizes = np.array([len(h) // 8 for h in hashes], dtype=np.int64)
    out = np.zeros((len(hashes), words), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.frombuffer(b"".join(hashes), dtype=">u8").astype(np.uint64)
    begin = np.concatenate(([0], np.cumsum(sizes[full])))
    runs = -(-sizes[full] // 255)
    owner = np.repeat(np.arange(len(full)), runs)
    first_run = np.concatenate(([0], np.cumsum(runs)))[:-1]
    starts = begin[owner] + 255 * (np.arange(len(owner)) - first_run[owner])
    for word in range(words):
        mixed = _mixed(flat, word)
        bits = np.zeros(len(full), dtype=np.uint64)
        for k in range(8):
            sums = np.add.reduceat((mixed >> np.uint64(k)) & _BYTES, starts)
            each = sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
            counts = np.add.reduceat(each, first_run, axis=0)
            on = (2 * counts > sizes[full][:, None]).astype(np.uint64)
            for byte in range(8):
                bits |= on[:, byte] << np.uint64(8 * byte + k)
        out[full, word] = bits
    return out


def _fingerprints(measure: Measure):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            hashes = [shingle_hashes(t, measure.width) for t in batch.column("_text").to_pylist()]
            found = [row.tobytes() for row in majority_bits(hashes, measure.words).astype(">u8")]
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame, measure: Measure = STRICT) -> DataFrame:
    """doc_id, text_key (tells rows that share an id apart) and fp, big-endian bytes."""
    ship_package(docs.sparkSession)
    source = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), binary_text().alias("_text")
    )
    return source.mapInArrow(_fingerprints(measure), "doc_id bigint, text_key bigint, fp binary")


def _sub_tiles(fps: np.ndarray):
    """Sort order, cuts, and the least and most set bits of each byte in each smaller tile."""
    ones = np.bitwise_count(fps.astype("<u8").view(np.uint8).reshape(-1, 8)).astype(np.int16)
    quarters = ones[:, 0::2] + ones[:, 1::2]
    order = np.lexsort((ones[:, 6], ones[:, 4], ones[:, 2], ones[:, 0], quarters[:, 2], quarters[:, 0]))
    cuts = np.arange(0, len(fps), SUBTILE)
    ones = ones[order]
    return order, cuts, np.minimum.reduceat(ones, cuts), np.maximum.reduceat(ones, cuts)


def _near(a: np.ndarray, b: np.ndarray | None, measure: Measure) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in a, and in b (or a again), of all pairs within the limits."""
    order_a, cuts_a, low_a, high_a = tiles_a = _sub_tiles(a[:, 0])
    order_b, cuts_b, low_b, high_b = tiles_a if b is None else _sub_tiles(b[:, 0])
    other_rows = a if b is None else b
    sorted_a, sorted_b = a[order_a, 0], other_rows[order_b, 0]
    for i, start in enumerate(cuts_a):
        gap = np.maximum(low_b - high_a[i], 0) + np.maximum(low_a[i] - high_b, 0)
        near = np.flatnonzero(gap.sum(axis=1) <= measure.near)
        mine = sorted_a[start : start + SUBTILE, None]
        for j in near[near >= i] if b is None else near:
            other = sorted_b[None, cuts_b[j] : cuts_b[j] + SUBTILE]
            x, y = np.nonzero(np.bitwise_count(mine ^ other) <= measure.near)
            if b is None and j == i:
                x, y = x[x < y], y[x < y]
            x, y = order_a[start + x], order_b[cuts_b[j] + y]
            if measure.second is not None and len(x):
                differ = np.bitwise_count(a[x, 0] ^ other_rows[y, 0]) + np.bitwise_count(a[x, 1] ^ other_rows[y, 1])
                x, y = x[differ <= measure.second], y[differ <= measure.second]
            if measure.words > 1 and len(x):
                differ = np.bitwise_count(a[x] ^ other_rows[y]).sum(axis=1)
                x, y = x[differ <= measure.radius], y[differ <= measure.radius]
            yield x, y


def close_pairs(a: np.ndarray, b: np.ndarray | None, measure: Measure = STRICT) -> tuple[np.ndarray, np.ndarray]:
    """Stars (position, root) of the links within tile a, or between tiles a and b.

    Rows are fingerprints. Positions of b follow those of a.
    """
    shift = 0 if b is None else len(a)
    links = Links(shift + len(a if b is None else b))
    for x, y in _near(a, b, measure):
        links.add(x, y + shift)
    return links.stars()


_EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _edges(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names[a], pa.binary()), pa.array(names[b], pa.binary())], schema=_EDGES)


def _sides(side: np.ndarray, fps: np.ndarray, measure: Measure):
    """Names in order of side, and the fingerprints (the first words of the names) of each side."""
    names = fps[np.argsort(side, kind="stable")]
    rows = np.frombuffer(b"".join(n[: 8 * measure.words] for n in names), dtype=">u8").astype(np.uint64)
    rows, first = rows.reshape(-1, measure.words), np.count_nonzero(side == 0)
    return names, rows[:first], rows[first:] if first < len(names) else None


def _per_tile_pair(found):
    """Rows (lo, hi, side, fp, ...) sorted by tile pair: edges that ``found`` makes of each pair of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            lo, hi, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            change = np.flatnonzero((np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            for start, stop in zip([0, *change], [*change, len(lo)]):
                here = (lo[start], hi[start])
                if held and here != key:
                    yield from found(*map(np.concatenate, zip(*held)))
                    held = []
                key = here
                held.append([c[start:stop].copy() for c in rest])
        if held:
            yield from found(*map(np.concatenate, zip(*held)))

    return run


def _compare(measure: Measure):
    """Stars of the links of each pair of tiles."""

    def found(side: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, first, second = _sides(side, fps, measure)
        yield _edges(names, *close_pairs(first, second, measure))

    return _per_tile_pair(found)


def tile_pairs(distinct: DataFrame, measure: Measure = STRICT, tile: int = TILE) -> DataFrame:
    """Rows (lo, hi, side, fp): every fingerprint once for each pair of tiles that it takes part in.

    A cell is a pair of bit counts of the halves of the first word, in steps of a third of the radius;
    there are at most 33 x 33. A cell above ``tile`` rows is dealt to several tiles by hash. A pair of
    equal tiles has side 0 only. Further columns of ``distinct`` follow.
    """
    spark = distinct.sparkSession
    step = max(1, measure.near // 3)

    def ones(at: int) -> Column:
        half = F.conv(F.hex(F.substring("fp", at, 4)), 16, 10).cast("bigint")
        return F.floor(F.bit_count(half) / step).cast("int")

    def apart(c: int, d: int) -> int:
        """Least difference in bit counts of two cells."""
        return sum(max(0, (abs(x - y) - 1) * step + 1) for x, y in zip(divmod(c, 33), divmod(d, 33)) if x != y)

    celled = distinct.withColumn("cell", ones(1) * 33 + ones(5))
    sizes = {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    tiles = {c: -(-n // tile) for c, n in sizes.items()}
    near = [
        (c, n, [d << 32 | t for d in tiles if apart(c, d) <= measure.near for t in range(tiles[d])]) for c, n in tiles.items()
    ]
    # One row per cell: at most 1089 of them.
    frame = F.broadcast(spark.createDataFrame(near, "cell int, tiles bigint, others array<bigint>"))
    own = (F.shiftleft(F.col("cell").cast("bigint"), 32) + F.pmod(F.xxhash64("fp"), F.col("tiles"))).alias("own")
    further = [c for c in distinct.columns if c != "fp"]
    pairs = celled.join(frame, "cell").select("fp", *further, own, F.explode("others").alias("other"))
    return pairs.select(
        F.least("own", "other").alias("lo"),
        F.greatest("own", "other").alias("hi"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "fp",
        *further,
    )


def _dealt(distinct: DataFrame, measure: Measure, tile: int) -> DataFrame:
    return tile_pairs(distinct, measure, tile).repartition("lo", "hi").sortWithinPartitions("lo", "hi")


def near_groups(docs: DataFrame, measure: Measure = STRICT, tile: int = TILE) -> DataFrame:
    """doc_id, text_key, fp, component_id and kept for every row.

    component_id is the smallest id reachable over the links of ``measure``. ``kept`` marks the
    row with that id; where several texts share it, the one with the smallest key.
    """
    rows, nodes = _nodes(fingerprints(docs, measure))
    roots = components(_dealt(nodes.select("fp"), measure, tile).mapInArrow(_compare(measure), "a binary, b binary"))
    return _grouped(rows, nodes, roots)


def _nodes(fingerprinted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows, and each different fp with its least row."""
    rows = store(fingerprinted, "fingerprints")
    # A null id stands behind all others.
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    return rows, store(rows.groupBy("fp").agg(F.min(place).alias("least")), "fingerprint-nodes")


def _grouped(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("first"))
    # Written, so that rows of a hot fingerprint can be split in the join.
    per_node = store(rooted.join(least, "root").select("fp", "first"), "fingerprint-components")
    return rows.join(per_node, "fp").select(
        "doc_id", "text_key", "fp", F.col("first.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, measure: Measure = STRICT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of ``near_groups``, with all their columns.

    The row with the smallest id stays. Of rows that repeat both id and text, the one whose other
    columns sort first stays.
    """
    groups = store(near_groups(docs, measure), "near-groups")
    keys = [F.col("doc_id").alias("__near_id"), F.col("text_key").alias("__near_key")]
    match = docs["doc_id"].eqNullSafe(F.col("__near_id")) & (text_key() == F.col("__near_key"))
    single = docs.join(groups.filter("not kept").select(*keys).distinct(), match, "left_anti")
    repeated = groups.filter("kept").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = store(repeated.select(*keys), "near-repeated")
    if repeated.isEmpty():
        return single
    order = [F.col(f"`{c}`").asc_nulls_last() for c in docs.columns]
    first = F.row_number().over(W.partitionBy("__near_id", "__near_key").orderBy(*order))
    chosen = docs.join(repeated, match).withColumn("__near_first", first).filter("__near_first = 1")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return single.join(repeated, match, "left_anti").unionByName(chosen.select(*names))


def op10(spark: SparkSession, directory: str) -> DataFrame:
    groups = near_groups(table(spark, directory, "documents"))
    return groups.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10}
