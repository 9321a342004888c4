"""Windows and gap filling for daily series.

A series is the rows that share ``keys``; it holds one row per day, so a window over one series
is bounded by the calendar. Callers roll order lines up to days before they come here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def series_window(keys: Sequence[str]) -> WindowSpec:
    """All rows of one series; without keys the frame is the one daily series there is."""
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))


def ordered(keys: Sequence[str], date: str = "date") -> WindowSpec:
    return series_window(keys).orderBy(date)


def lag(value: str | Column, k: int, keys: Sequence[str], date: str = "date") -> Column:
    return F.lag(value, k).over(ordered(keys, date))


def trailing(agg: Column, rows: int, keys: Sequence[str], date: str = "date") -> Column:
    """Aggregate of the current row and the rows before it; short at the start of a series."""
    return agg.over(ordered(keys, date).rowsBetween(-(rows - 1), 0))


def centred(agg: Column, value: str, rows: int, keys: Sequence[str], date: str = "date") -> Column:
    """Aggregate over a window centred on the row, null unless the window is full."""
    half = rows // 2
    frame = ordered(keys, date).rowsBetween(-half, rows - 1 - half)
    return F.when(F.count(value).over(frame) == rows, agg.over(frame))


def previous(agg: Column, value: str, rows: int, keys: Sequence[str], date: str = "date") -> Column:
    """Aggregate over the rows before this one, null unless all of them are there."""
    frame = ordered(keys, date).rowsBetween(-rows, -1)
    return F.when(F.count(value).over(frame) == rows, agg.over(frame))


def row_position(keys: Sequence[str], date: str = "date") -> Column:
    """Position of a day within its series, from 0."""
    return F.row_number().over(ordered(keys, date)) - 1


def date_spine(df: DataFrame, date: str = "date") -> DataFrame:
    """Every day between the first and the last date of the frame."""
    ends = df.agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    return ends.select(F.explode(F.sequence("_a", "_b")).alias(date))


def densify(df: DataFrame, keys: Sequence[str], values: Sequence[str], date: str = "date") -> DataFrame:
    """Add the missing days of every series, with zero values.

    Each row unfolds into itself and the gap up to the next row of its series, so one pass fills
    all gaps without a join. With keys, every series is stretched to the span of the whole frame.
    """
    keys = list(keys)
    w = ordered(keys, date)
    day = F.col(date)
    first, last = day, day
    if keys:
        span = df.select(F.struct(F.min(date).alias("a"), F.max(date).alias("b"))).scalar()
        first, last = span["a"], span["b"]
    starts = F.when(F.lag(date).over(w).isNull(), first).otherwise(day)
    ends = F.greatest(F.coalesce(F.date_sub(F.lead(date).over(w), 1), last), day)
    rows = df.select(*keys, day.alias("_own"), *values, starts.alias("_a"), ends.alias("_b"))
    days = rows.select(*keys, "_own", *values, F.explode(F.sequence("_a", "_b")).alias(date))
    present = F.col(date) == F.col("_own")
    return days.select(
        *keys, date, *[F.when(present, F.coalesce(v, F.lit(0.0))).otherwise(F.lit(0.0)).alias(v) for v in values]
    )
