"""CSV and Parquet readers for the logical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources.schemas import REGISTRY, TableSpec


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the header line in lower case: the audit's view of a file."""
    raw = spark.read.option("header", True).csv(path)
    return raw.toDF(*[c.strip().lower() for c in raw.columns])


def _typed(name: str, dtype: T.DataType) -> Column:
    text = F.trim(F.col(name))
    if isinstance(dtype, T.DateType):
        return F.coalesce(F.try_to_date(text), F.to_date(F.try_to_timestamp(text)))
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        # A nullable integer column may have been written as "12.0".
        return F.coalesce(text.try_cast(dtype), text.try_cast("double").try_cast(dtype))
    if isinstance(dtype, T.StringType):
        return F.col(name)
    return text.try_cast(dtype)


def apply_schema(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """Cast text columns to the declared types; a value that does not parse becomes null."""
    present = set(raw.columns)
    return raw.select(
        *[_typed(n, t).alias(n) for n, t, _ in spec.fields if n in present],
        *[c for c in raw.columns if c not in {n for n, _, _ in spec.fields}],
    )


def read_csv_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One CSV file by logical name, typed, dates parsed leniently."""
    return apply_schema(read_raw(spark, f"{directory}/{name}.csv"), REGISTRY.tables[name])


def read_parquet_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_evidence(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Read back a result table written by ``writers.write_evidence``."""
    return spark.read.parquet(f"{directory}/{name}")
