"""Sinks: result tables as Parquet, and ordered CSV exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_evidence(df: DataFrame, directory: str, name: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write one result table as Parquet and return its path."""
    path = f"{directory}/{name}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, order_by: list[str | Column]) -> None:
    """CSV with a header, globally sorted across the part files."""
    df.orderBy(*order_by).write.mode("overwrite").option("header", True).csv(path)


def ordered_export(
    template: DataFrame,
    forecast: DataFrame,
    keys: list[str],
    values: list[str],
    date: str = "date",
    row_id: str = "row_id",
) -> DataFrame:
    """Forecast values in the row order of a template, dates as ``yyyy-MM-dd`` text.

    Every template row is kept; a date without a forecast shows as null so that the output
    check can find it.
    """
    joined = template.select(*keys, date, row_id).join(forecast.select(*keys, date, *values), [*keys, date], "left")
    return joined.select(
        *keys, row_id, F.date_format(date, "yyyy-MM-dd").alias(date), *values
    ).orderBy(*keys, row_id)
