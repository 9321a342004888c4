"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash. A source that needs a fraction of its words takes the documents
whose hash lies below a threshold; one that needs more than all takes whole copies of everything and
the fraction on top. The threshold is found without sorting: words are summed by source and hash
bucket, the bucket in which the budget runs out is cut again, and so on until it holds one hash.
Thresholds are nested: a larger budget keeps every document that a smaller one took.

Defined results: null text has size 0; a null source is a source of its own, last in order; a source
without words has target 0. The document at the threshold is taken when at least half of it fits.
Rows that repeat id and text share a hash and are taken or left together. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import table
from tallyloom.session import store

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
HASH_BITS, LEVEL_BITS = 60, 12


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of a digest of the id and the text."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size and target, from rows of (source, size).

    Sources share the sum of all sizes by weight. Sorted by the multiple of its weight at which a
    source is used up, those before some place get all they can give and the rest share by weight;
    the first place where that holds is the answer. These windows see one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    named = totals.withColumn("weight", F.get(cycle, place)).withColumn("cap", max_copies * F.col("source_size"))
    ratio = F.col("cap").cast("double") / F.col("weight")
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    used_up = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    share = (F.sum("source_size").over(whole) - used_up).cast("double") / rest
    shared = named.withColumn("ratio", ratio).withColumn("share", share)
    level = F.min(F.when(F.col("share") <= F.col("ratio"), F.struct("ratio", "share"))).over(whole)["share"]
    target = F.least(F.coalesce(level, F.lit(0.0)) * F.col("weight"), F.col("cap").cast("double"))
    return shared.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """Per source: ``whole`` copies of every document and ``threshold`` of the hash for one more.

    ``sized`` has rows of (source, size, hash). Each round reads only the boundary bucket of each
    source and leaves one row per source.
    """
    whole = F.least(F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)), F.lit(max_copies))
    budget = F.col("target") - F.col("whole") * F.col("source_size")
    state = (
        targets.withColumn("whole", whole.cast("bigint"))
        .withColumn("left", budget)
        .select("source", "source_size", "target", "whole", "left", F.lit(0).cast("bigint").alias("prefix"))
        .withColumns({"one": F.lit(False), "tokens": F.col("source_size")})
    )
    state = store(state, "mix-targets")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        open_ = state.filter("not one").select(F.col("source").alias("s"), "prefix", "left")
        inside = (F.col("source").eqNullSafe(F.col("s"))) & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        sums = (
            sized.join(open_, inside)
            .groupBy("s", "left", F.shiftright("hash", shift).alias("bucket"))
            .agg(F.sum("size").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        )
        until = F.sum("n").over(W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        edge = (
            sums.withColumn("until", until)
            .filter(F.col("until") > F.col("left"))
            .groupBy("s")
            .agg(F.min_by(F.struct("bucket", "n", "lo", "hi", "until", "left"), "bucket").alias("e"))
        )
        found = F.col("e").isNotNull()
        one = F.col("e.lo") == F.col("e.hi")
        state = state.join(edge, F.col("source").eqNullSafe(F.col("s")) & ~F.col("one"), "left").select(
            "source", "source_size", "target", "whole",
            F.when(found, F.col("e.left") - (F.col("e.until") - F.col("e.n"))).otherwise(F.col("left")).alias("left"),
            F.when(found & one, F.col("e.lo")).when(found, F.col("e.bucket")).otherwise(F.col("prefix")).alias("prefix"),
            # A source whose budget is never exceeded (no words, or all taken) is settled as well.
            (F.col("one") | ~found | one).alias("one"),
            F.when(found, F.col("e.n")).when(F.col("one"), F.col("tokens")).otherwise(F.lit(None)).alias("tokens"),
        )
        state = store(state, "mix-level")
        if state.filter("not one").isEmpty():
            break
    above = (F.col("left") * 2 >= F.col("tokens")).cast("bigint")
    everything = F.lit((1 << HASH_BITS) + 1).cast("bigint")
    cut = F.when(F.col("tokens").isNull(), everything).otherwise(F.col("prefix") + above)
    cut = F.when((F.col("left") <= 0) | (F.col("whole") >= max_copies), F.lit(0).cast("bigint")).otherwise(cut)
    return state.select("source", "source_size", "target", "whole", cut.alias("threshold"))


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, hash) of every document, and the thresholds of the sources."""
    sized = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "source",
        words(F.col("text")).alias("size"),
        document_hash(F.col("doc_id"), F.col("text")).alias("hash"),
    )
    sized = store(sized, "mix-sizes")
    return sized, thresholds(sized, store(source_targets(sized, weights), "mix-sources"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """One row per document with the words that the mix takes of it."""
    sized, cuts = plan_mix(docs, weights)
    cuts = cuts.withColumnRenamed("source", "s")
    copies = F.col("whole") + (F.col("hash") < F.col("threshold")).cast("bigint")
    return sized.join(cuts, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken")
    )


def apply_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken."""
    _, cuts = plan_mix(docs, weights)
    cuts = cuts.select(F.col("source").alias("__mix_source"), F.col("whole").alias("__mix_whole"), F.col("threshold").alias("__mix_cut"))
    extra = document_hash(docs["doc_id"], docs["text"]) < F.col("__mix_cut")
    copies = F.col("__mix_whole") + extra.cast("bigint")
    joined = docs.join(cuts, docs["source"].eqNullSafe(F.col("__mix_source")))
    times = F.array_repeat(F.lit(0), copies.cast("int"))
    return joined.withColumn("__mix_copy", F.explode(times)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3(spark: SparkSession, directory: str) -> DataFrame:
    return mix(table(spark, directory, "documents"))


QUERIES = {"op3_mix_sources": op3}
SQL = {
    "op3_mix_sources": r"""
        with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
                cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15) as bigint) as h
                from documents),
        s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
        w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight,
              3 * source_size as cap from s),
        r as (select *, cast(cap as double) / weight as ratio from w),
        l as (select *, cast(sum(source_size) over () - coalesce(sum(cap) over (order by ratio, source nulls last
                rows between unbounded preceding and 1 preceding), 0) as double)
                / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as share from r),
        t as (select source, source_size, least(coalesce((select arg_min(share, ratio) from l where share <= ratio), 0e0) * weight,
              cast(cap as double)) as target from l),
        b as (select *, case when source_size = 0 then 0 else least(cast(floor(target / source_size) as bigint), 3) end as whole from t),
        o as (select d.*, source_size, target, whole, target - whole * source_size as budget,
              coalesce(sum(size) over (partition by d.source order by h rows between unbounded preceding and 1 preceding), 0) as before
              from d join b on d.source is not distinct from b.source)
        select doc_id, size, source_size, target,
               cast(size * (whole + case when whole >= 3 or budget <= 0 then 0 when before + size <= budget then 1
                    when before <= budget and 2 * (budget - before) >= size then 1 else 0 end) as bigint) as taken
        from o"""
}
