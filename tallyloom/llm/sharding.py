"""Sharding by longest processing time: equal texts stay together, shards get nearly equal bytes.

Groups sorted by size go to the least loaded shard, which a heap gives. Groups of one size can change
places without changing any load, so the driver deals classes: a size and its number of groups. A class of
few groups goes through the heap group by group; for a larger one the same picks are counted at once, as
those of the least loads that the class can make. There is one class per distinct size, and as the sizes of
classes add up to no more than all bytes, there are fewer than the square root of twice the bytes, whatever
the number of groups. Ranks inside a class then say which of its groups goes to which shard.

Defined results: null text counts as empty and as equal to it; its size is 1. Repeated rows are rows
of the same group. Ids are used to order slots only, so null ids are allowed. An empty table gives no
rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import gapless_rank, table
from tallyloom.session import store

SHARDS = 16
#: A class of up to so many groups per shard goes through the heap one by one; the result is the same.
FEW = 4
#: Groups of one class that are ranked in one task.
RANKED = 250_000
#: Groups with more than this share of all rows travel to the rows; there are at most ``1 / HOT`` of them.
HOT = 1 / 4096
#: Bytes up to which the dealt classes travel to the groups, and the parts of a join beyond that.
BROADCAST, SALTS = 16 << 20, 32


def _picks(loads: list[int], size: int, count: int) -> np.ndarray:
    """How many of ``count`` items of one size each shard gets, the least loaded first.

    Shard k would be picked at the loads ``loads[k]``, ``loads[k] + size`` and so on; the picks are the
    ``count`` least of them, ties to the smaller shard.
    """
    base = np.asarray(loads, dtype=np.int64)

    def below(level: int) -> np.ndarray:
        return np.maximum(0, -((base - level) // size))

    low, high = int(base.min()), int(base.min()) + count * size + 1
    while high - low > 1:
        middle = (low + high) // 2
        if below(middle).sum() <= count:
            low = middle
        else:
            high = middle
    picks = below(low)
    ties = np.flatnonzero(base + picks * size == low)
    picks[ties[: count - int(picks.sum())]] += 1
    return picks


def longest_first(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, dict[int, int]]]:
    """(size, number, {shard: how many of them}) for classes (size, number) given from large to small."""
    heap = [(0, k) for k in range(shards)]
    for size, number in classes:
        if number <= FEW * shards:
            picks: dict[int, int] = {}
            for _ in range(number):
                load, k = heap[0]
                heapq.heapreplace(heap, (load + size, k))
                picks[k] = picks.get(k, 0) + 1
        else:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            many = _picks(loads, size, number)
            picks = {k: int(n) for k, n in enumerate(many) if n}
            heap = [(load + int(n) * size, k) for k, (load, n) in enumerate(zip(loads, many))]
            heapq.heapify(heap)
        yield size, number, picks


def _deal(classes: pa.Table, shards: int) -> pa.Table:
    """For each class the shards it goes to, and the ranks at which the next of them begins."""
    sizes, ends, where, number = [], [], [], []
    for size, n, picks in longest_first(zip(classes["bytes"].to_pylist(), classes["n"].to_pylist()), shards):
        order = sorted(picks)
        sizes.append(size)
        number.append(n)
        where.append(order)
        ends.append(np.cumsum([picks[k] for k in order]).tolist())
    return pa.table(
        {
            "_bytes": pa.array(sizes, pa.int64()),
            "_of": pa.array(number, pa.int64()),
            "_ends": pa.array(ends, pa.list_(pa.int64())),
            "_shards": pa.array(where, pa.list_(pa.int32())),
        }
    )


def place(groups: DataFrame, shards: int, ranked: int = RANKED, broadcast: int = BROADCAST) -> DataFrame:
    """``groups`` (group, bytes and more) with the shard of each.

    Ranks in a class are counted in tasks of about ``ranked`` groups, so that a class may hold any part
    of all groups.
    """
    spark = groups.sparkSession
    classes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("bytes").desc())
    plan = _deal(classes.toArrow(), shards)
    dealt = spark.createDataFrame(plan) if plan.num_rows else spark.createDataFrame(
        [], "_bytes bigint, _of bigint, _ends array<bigint>, _shards array<int>"
    )
    bucket = F.pmod(F.xxhash64("group"), F.floor(F.col("_of") / F.lit(ranked)) + 1).alias("_bucket")
    if plan.nbytes <= broadcast:
        joined = groups.join(F.broadcast(dealt), F.col("bytes") == F.col("_bytes"))
    else:
        salt = F.pmod(F.xxhash64("group"), F.lit(SALTS)).cast("int")
        copies = dealt.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = groups.join(copies, (F.col("bytes") == F.col("_bytes")) & (salt == F.col("_copy"))).drop("_copy")
    joined = joined.select("*", bucket)
    # Only classes of several buckets have a shift; there is one row per ``ranked`` groups.
    counts = joined.filter(F.col("_of") >= ranked).groupBy("bytes", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("bytes").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select("bytes", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    local = F.row_number().over(W.partitionBy("bytes", "_bucket").orderBy("group")) - 1
    rank = F.col("_local") + F.coalesce("_shift", F.lit(0))
    at = F.size(F.filter("_ends", lambda end: end <= F.col("_rank"))) + 1
    return (
        joined.withColumn("_local", local)
        .join(shift, ["bytes", "_bucket"], "left")
        .withColumn("_rank", rank)
        .select(*groups.columns, F.element_at("_shards", at).alias("shard"))
    )


def shard(docs: DataFrame, shards: int = SHARDS, hot: float = HOT, ranked: int = RANKED, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    The digest of the text names a group; texts are read once and go no further. Groups of many rows
    travel to their rows, so that none is one task of a join.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = store(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text).cast("bigint") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("group"),
        ),
        "shard-rows",
    )
    # Partial sums first: a group of any number of rows is one row per task in the shuffle.
    groups = store(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    placed = store(place(groups, shards, ranked, broadcast), "shard-placed")
    most = (groups.agg(F.sum("rows")).first()[0] or 0) * hot
    frequent = F.broadcast(placed.filter(F.col("rows") > most).select("group", "shard"))
    rest = placed.filter(F.col("rows") <= most).select("group", "shard")
    located = rows.join(frequent, "group").unionByName(rows.join(frequent, "group", "left_anti").join(rest, "group"))
    located = located.select("doc_id", "size", "text_crc32", "shard")
    return gapless_rank(located, ["shard"], ["doc_id", "text_crc32"]).withColumnRenamed("rank", "slot")


def op5(spark: SparkSession, directory: str) -> DataFrame:
    placed = shard(table(spark, directory, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op5_longest_first_sharding": op5}
