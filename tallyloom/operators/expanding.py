"""Medians of all earlier values, for series of any length.

A percentile over a growing frame keeps the values of a series in one task and orders them again for every
row. Here rows are cut into blocks by time, and a block answers all its rows at once:

1. Rows are numbered by time and values by size, series after series in both orders. What belongs to an earlier
   series then comes first in both. Positions in time are cut into blocks, ranks of values into cells, both of
   ``block_rows``. How many values of each cell came before each block is carried from block to block.
2. Only the first series of a block has values in earlier blocks. While the block passes, its median moves over no
   more of them than the block has values. They lie in few neighbouring cells, which the counts tell; the block
   gets the earlier values of these cells and the number of those below.
3. With them and its own values a block finds the wanted order statistics of all its rows in one descent by bits.

A block gets at most its own number of earlier values and two cells. It has at least as many rows as there are
blocks, so the table of cells and blocks is no longer than the input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.blocks import BLOCK, BLOCK_ROWS, POSITION, block_of, numbered
from tallyloom.functions.quantile import FEW_ROWS
from tallyloom.session import ship_package, store


def smallest(codes: np.ndarray, upto: np.ndarray, k: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each question the code of the ``k``-th smallest of ``before`` and the first ``upto`` codes.

    ``before[c]`` values of code c count in every question. Also returns how many values of the same code
    precede the one found. All questions go down the bits of the codes together.
    """
    bits = max(1, int(len(before) - 1).bit_length())
    below = np.zeros((1 << bits) + 1, np.int64)
    below[1 : len(before) + 1] = np.cumsum(before)
    below[len(before) + 1 :] = below[len(before)]
    left, right, found = np.zeros_like(upto), upto.copy(), np.zeros_like(upto)
    for bit in reversed(range(bits)):
        one = ((codes >> bit) & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        z_left, z_right = zeros[left], zeros[right]
        low = z_right - z_left + below[found + (1 << bit)] - below[found]
        up = k >= low
        k = np.where(up, k - low, k)
        found = found + (up.astype(np.int64) << bit)
        left = np.where(up, zeros[-1] + left - z_left, z_left)
        right = np.where(up, zeros[-1] + right - z_right, z_right)
        codes = np.concatenate([codes[~one], codes[one]])
    return found, k


def near_median(values: DataFrame, firsts: DataFrame, blocks: int, cells: int) -> DataFrame:
    """The cells each block needs earlier values of: ``_cell``, ``_first``, ``_past`` and ``_under`` per block.

    ``values`` has a block and a cell per value, ``firsts`` per block the rank of the first value of the series
    that the block begins in. ``_past`` values of that series came before the block, ``_under`` of them below its cells.
    """
    counts = values.groupBy("_cell", BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    grid = values.sparkSession.range(cells).select(
        F.col("id").alias("_cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias(BLOCK)
    )
    earlier = W.partitionBy("_cell").orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = grid.join(counts, ["_cell", BLOCK], "left").select(
        BLOCK,
        "_cell",
        F.coalesce("_n", F.lit(0)).cast("long").alias("_n"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("long").alias("_before"),
    )
    # Values of the block and of all before it, in all cells up to this one.
    upto = W.partitionBy(BLOCK).orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    sums = carried.select(
        *carried.columns,
        *[F.sum(c).over(upto).alias(f"{c}_upto") for c in ("_n", "_before")],
        *[F.sum(c).over(W.partitionBy(BLOCK)).alias(f"{c}_all") for c in ("_n", "_before")],
    ).join(F.broadcast(firsts), BLOCK)
    below = F.col("_before_upto") - F.col("_before")
    past = F.col("_before_all") - F.col("_first")
    above = F.col("_n_all") - F.col("_n_upto") + F.col("_n")
    # The median is lowest when the block's values up to the cell have come and no others, highest when those from
    # the cell on have come and no others.
    lowest = F.col("_first") + F.call_function("div", past + F.col("_n_upto") - 1, F.lit(2).cast("long"))
    highest = F.col("_first") + F.call_function("div", past + above, F.lit(2).cast("long"))
    asked = sums.filter(
        (past > 0) & (F.col("_before") > 0) & (F.col("_before_upto") + F.col("_n_upto") > lowest) & (below <= highest)
    )
    under = F.greatest(F.min(below).over(W.partitionBy(BLOCK)) - F.col("_first"), F.lit(0).cast("long"))
    return asked.select(BLOCK, "_cell", "_first", past.alias("_past"), under.alias("_under"))


def expanding_median(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "past_median",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds the median of the strictly earlier values of the row's series, as double.

    Null before the first value; null values count as rows, not as values. Nulls in keys are one series.
    ``order`` should be unique within a series.
    """
    spark, keys, own = df.sparkSession, list(keys), df.columns
    ship_package(spark)
    x, rows = numbered(df, order, keys)
    size = max(block_rows, math.isqrt(rows) + 1)
    own_block = block_of(POSITION, size).alias(BLOCK)
    asking = x.select("*", own_block, F.col(value).cast("double").alias("_v"), F.col(value).isNotNull().alias("_is_value"))
    values, ranks = numbered(asking.filter("_is_value").select(*keys, POSITION, BLOCK, "_v"), ["_v", POSITION], keys, "_rank")
    values = values.withColumn("_cell", block_of("_rank", size))

    # The rank of the first value of the series that a block begins in, one row per block.
    heads = asking.filter(F.col(POSITION) == F.col(BLOCK) * size).select(
        BLOCK, *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]
    )
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    series = values.groupBy(*keys).agg(F.min("_rank").alias("_first")).filter(F.col("_first").isNotNull())
    firsts = series.join(F.broadcast(heads), same).select(BLOCK, "_first")
    blocks, cells = (max(1, -(-n // size)) for n in (rows, ranks))
    near = store(near_median(values, firsts, blocks, cells), "near")

    # A cell may be needed by very many blocks: its values are spread before they are copied. Cells by blocks are
    # few unless a hostile order keeps the median among values that lie far apart.
    at_hand = F.broadcast if near.count() <= FEW_ROWS else lambda small: small
    last = F.broadcast(near.groupBy("_cell").agg(F.max(BLOCK).alias("_last")))
    copies = (
        values.withColumnRenamed(BLOCK, "_own")
        .join(last, "_cell")
        .filter(F.col("_own") < F.col("_last"))
        .select("_cell", "_own", "_rank", "_v")
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_rank")
        .join(at_hand(near.select("_cell", BLOCK, "_first")), "_cell")
        .filter((F.col("_own") < F.col(BLOCK)) & (F.col("_rank") >= F.col("_first")))
        .select(BLOCK, "_v")
    )

    def find_medians(block: pa.Table, earlier: pa.Table) -> pa.Table:
        by_time = np.argsort(block[POSITION].to_numpy())
        is_value, begins = (block[c].to_numpy()[by_time] for c in ("_is_value", "_begins"))
        begins[:1] = False
        series = np.cumsum(begins)
        before = np.cumsum(is_value) - is_value
        # Values of the block in earlier series, and for the first series what came before the block.
        own_first = before[np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0))]
        seen = before - own_first + np.where(series == 0, block["_past"].to_numpy(), 0)
        first = np.where(series == 0, -block["_under"].to_numpy(), own_first + len(earlier))
        v = np.concatenate([earlier["_v"].to_numpy(), block["_v"].to_numpy()[by_time][is_value]])
        by_size = np.lexsort((v, np.concatenate([np.zeros(len(earlier), np.int64), series[is_value]])))
        codes = np.empty(len(v), np.int64)
        codes[by_size] = np.arange(len(v))
        held = (by_size < len(earlier)).astype(np.int64)

        def at(middle: np.ndarray, ask: np.ndarray) -> np.ndarray:
            code, _ = smallest(codes[len(earlier) :], before[ask], (first + middle)[ask], held)
            return v[by_size[code]]

        ask, even = seen > 0, seen % 2 == 0
        low, high = np.zeros(len(seen)), np.zeros(len(seen))
        low[ask] = at((seen - 1) // 2, ask)
        high[ask & even] = at(seen // 2, ask & even)
        medians, none = np.empty(len(seen)), np.empty(len(seen), bool)
        medians[by_time], none[by_time] = low / 2 + np.where(even, high, low) / 2, ~ask
        return block.select(own).append_column(name, pa.array(medians, pa.float64(), mask=none))

    begins = F.lit(False)
    if keys:
        begins = ~F.struct(*keys).eqNullSafe(F.lag(F.struct(*keys)).over(W.partitionBy(BLOCK).orderBy(POSITION)))
    past = F.broadcast(near.select(BLOCK, "_past", "_under").distinct())
    asking = asking.withColumn("_begins", begins).join(past, BLOCK, "left").fillna(0, ["_past", "_under"])
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return store(asking.groupBy(BLOCK).cogroup(copies.groupBy(BLOCK)).applyInArrow(find_medians, schema), "medians")
