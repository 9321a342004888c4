"""Shared by the corpus operators: reading, arrow batches, gapless ranks, connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import store

#: White space that separates words, as a class for Spark's and Python's expressions.
SPACE = r"[\x20\x09-\x0D]+"
#: Text that is handled at once inside a task, so that working arrays stay small.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the id as text, the number that every held-out split is taken from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def binary_text(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut arrow batches so that the named binary column holds about ``limit`` bytes in each.

    A single longer value still travels alone and whole.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def gapless_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_bucket: int = 250_000) -> DataFrame:
    """Add ``rank``: positions from 0 without gaps within each key, for keys of any size.

    No key is ordered in one task: rows are dealt to hash buckets, ordered there, and shifted by the
    rows of the earlier buckets of the key. Rows that agree in ``order`` may swap places.
    """
    spread = max(8, int(df.count() // rows_per_bucket) + 1)
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(spread)))
    group = [*keys, "_bucket"]
    counts = bucketed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select(
        *[F.col(c).alias(f"_of_{c}") for c in group], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")
    )
    local = bucketed.withColumn("_local", F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1)
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return local.join(shift, same).select(*df.columns, (F.col("_shift") + F.col("_local")).alias("rank"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of undirected links (a, b); root is the smallest node reachable.

    Alternating stars: every node hands its larger neighbours, then all of them, its smallest one,
    until the links are stars around the roots. Each round is written to the shared folder. A node
    with many neighbours is one partial minimum before any shuffle; its rows in the joins can be
    split by adaptive execution.
    """

    def settled(df: DataFrame) -> tuple[DataFrame, tuple]:
        kept = store(df, "links")
        row = kept.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")),
            F.sum(F.xxhash64("b", "a").cast("decimal(20,0)")),
        ).first()
        return kept, tuple(row)

    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    links, state = settled(edges.filter("a != b").select(larger, smaller).distinct())
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        moved = big.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links, after = settled(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        if after == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = after
