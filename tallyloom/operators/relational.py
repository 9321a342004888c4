"""Small relational operators that the analyses are built from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.expr import col, ratio


def share_of_total(df: DataFrame, value: str, name: str = "share", within: Sequence[str] = ()) -> DataFrame:
    """Share of each row in its group's total; meant for rows that are already aggregated."""
    frame = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    return df.withColumn(name, ratio(value, F.sum(value).over(frame)))


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """Count of each non-null value with its share, most frequent first."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return share_of_total(counted, "count").orderBy(F.col("count").desc(), column)


def top_n(df: DataFrame, n: int, /, **ascending: bool) -> DataFrame:
    """First ``n`` rows by the named columns, ``True`` for ascending; name a key last to break ties."""
    order = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in ascending.items()]
    return df.orderBy(*order).limit(n)


def nearest_reference(value: str | Column, options: Mapping[str, float]) -> Column:
    """Label of the reference value closest to a measured one; ties go to the first label."""
    v = col(value)
    labelled = F.array(
        *[F.struct(F.abs(v - F.lit(float(o))).alias("distance"), F.lit(k).alias("label")) for k, o in options.items()]
    )
    best = F.array_min(labelled)
    return F.when(v.isNotNull(), F.struct(best["label"].alias("label"), best["distance"].alias("distance")))


def concentration(df: DataFrame, share: str) -> DataFrame:
    """Sum of squared shares: 1/n when even, 1 when one row holds everything."""
    return df.agg(F.sum(F.pow(share, F.lit(2.0))).alias("herfindahl"))


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only, with the side they are on."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(
        b.join(a, key, "left_anti").withColumn("side", F.lit("right_only"))
    )


def numeric_summary(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum of each column.

    Quartiles are exact and keep the distinct values of a group in memory: meant for daily
    series and forecasts. ``functions.quantile.exact_quantiles`` serves larger groups.
    """
    stats = {
        "count": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "q25": lambda c: F.percentile(c, F.lit(0.25)),
        "q50": lambda c: F.percentile(c, F.lit(0.5)),
        "q75": lambda c: F.percentile(c, F.lit(0.75)),
        "max": F.max,
    }
    row = df.groupBy(*keys).agg(*[build(c).alias(f"{c}__{s}") for c in columns for s, build in stats.items()])
    lines = F.array(
        *[F.struct(F.lit(c).alias("metric"), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in columns]
    )
    return row.select(*keys, F.inline(lines))


def row_spread(columns: Sequence[str]) -> tuple[Column, Column]:
    """Mean and sample standard deviation across columns of one row."""
    n = len(columns)
    mean = sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / F.lit(float(n))
    squares = [F.pow(F.col(c) - mean, F.lit(2.0)) for c in columns]
    return mean, F.sqrt(sum(squares[1:], squares[0]) / F.lit(float(n - 1)))
