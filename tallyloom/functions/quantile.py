"""Exact quantiles for groups of any size.

``percentile`` keeps every distinct value of a group in one task. That is right for a group
bounded by the calendar (days of one series) and wrong for, say, all customers of one channel.
``exact_quantiles`` finds the same numbers by narrowing: count values in equal-width cells, keep
the cells that hold a wanted rank, cut those again, and order only what is left, in cells of bounded
size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import store

#: Rows of a frame of cells or groups that every task may hold.
FEW_ROWS = 100_000


def _ranks(probs: Sequence[float], total: Column) -> list[tuple[Column, Column, Column]]:
    """(lower rank, upper rank, weight of the upper) of each probability, ranks from 0."""
    out = []
    for p in probs:
        pos = (total - F.lit(1)).cast("double") * F.lit(float(p))
        low = F.floor(pos)
        out.append((low, F.ceil(pos), pos - low))
    return out


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    bins: int = 1024,
    cell_rows: int = 100_000,
) -> DataFrame:
    """One row per key with a column per entry of ``probs``; linear interpolation between ranks.

    Equal values are counted together first, so a value shared by many rows is one row here. Then the
    cells that hold a wanted rank are cut into ``bins`` parts between their own least and largest value,
    until none that is left has more than ``cell_rows`` values. Each round parts the ends of a cell, so
    outliers cost rounds and never a large cell; the cells only steer the search, the answer is exact.
    Null values and null keys are left out. What is left of a round is written to the shared folder.
    Values meet their cell where they lie: a join by shuffle would bring all of a group to one task.
    """
    keys = list(keys)
    if not keys:
        every = df.withColumn("_all", F.lit(1))
        return exact_quantiles(every, ["_all"], value, probs, bins, cell_rows).drop("_all")
    x = df.select(*keys, F.col(value).cast("double").alias("_v"))
    for c in [*keys, "_v"]:
        x = x.filter(F.col(c).isNotNull())
    x = store(x.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), "values")
    totals = x.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    # A cell is named by the number of values before it.
    # Two ranks a probability: no more cells than that are kept of a group.
    at_hand = F.broadcast if totals.count() * 2 * len(probs) <= FEW_ROWS else lambda small: small
    x = x.join(at_hand(totals), keys).withColumn("_cell", F.lit(0).cast("long"))
    group = [*keys, "_cell"]
    while largest_cell(x, group) > cell_rows:
        x = store(_narrowed(x, keys, list(probs.values()), bins, at_hand), "cells")
    x = x.withColumn("_before", F.col("_cell"))
    ordered = W.partitionBy(*group).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_end", F.col("_before") + F.sum("_n").over(ordered))
    x = x.withColumn("_start", F.col("_end") - F.col("_n"))
    aggs = [F.max("_total").alias("_total")]
    for i, (low, high, _) in enumerate(_ranks(list(probs.values()), F.col("_total"))):
        for tag, rank in (("lo", low), ("hi", high)):
            here = (rank >= F.col("_start")) & (rank < F.col("_end"))
            aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"_{tag}{i}"))
    out = x.groupBy(*keys).agg(*aggs)
    final = []
    for i, (name, (_, _, weight)) in enumerate(
        zip(probs, _ranks(list(probs.values()), F.col("_total")))
    ):
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        final.append((low + (high - low) * weight).alias(name))
    return out.select(*keys, *final)


def largest_cell(x: DataFrame, group: Sequence[str]) -> int:
    """Distinct values of the largest cell that is left."""
    return x.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows")).first()[0] or 0


def _narrowed(x: DataFrame, keys: Sequence[str], probs: Sequence[float], bins: int, at_hand: Callable) -> DataFrame:
    """Cut every cell and keep the parts that hold a wanted rank."""
    group = [*keys, "_cell"]
    span = x.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # Halves first: the width of a cell may exceed the largest double.
    share = F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
    part = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1).cast("long"))
    x = x.join(at_hand(span), group).withColumn("_part", F.when(F.col("_v") == F.col("_hi"), bins - 1).otherwise(part)).drop("_lo", "_hi")
    cells = x.groupBy(*group, "_part", "_total").agg(F.sum("_n").alias("_c"))
    running = F.sum("_c").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, 0))
    cells = cells.withColumn("_start", F.col("_cell") + running - F.col("_c"))
    start, end = F.col("_start"), F.col("_start") + F.col("_c")
    wanted = F.lit(False)
    for low, high, _ in _ranks(probs, F.col("_total")):
        wanted = wanted | ((low >= start) & (low < end)) | ((high >= start) & (high < end))
    kept = cells.filter(wanted).select(*group, "_part", "_start")
    return x.join(at_hand(kept), [*group, "_part"]).select(*keys, "_v", "_n", "_total", F.col("_start").alias("_cell"))


def bounded_quantile(value: str | Column, p: float, frequency: str | Column | None = None) -> Column:
    """Exact percentile as an aggregate, for groups whose distinct values are few by nature.

    ``frequency`` weights each value, so callers can count equal values first.
    """
    value = F.col(value) if isinstance(value, str) else value
    if frequency is None:
        return F.percentile(value, F.lit(p))
    frequency = F.col(frequency) if isinstance(frequency, str) else frequency
    return F.percentile(value, F.lit(p), frequency)
