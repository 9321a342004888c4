import heapq
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyloom.llm import sharding as H

from .fixtures import documents, nothing, rows


def one_by_one(sizes, shards):
    """Longest first over single groups: how many of each size every shard gets, and the loads."""
    heap, found = [(0, k) for k in range(shards)], Counter()
    for size in sorted(sizes, reverse=True):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
        found[size, k] += 1
    return found, {k: load for load, k in heap}


def test_groups_stay_together_and_slots_have_no_gaps(spark):
    found = H.shard(documents(spark)).collect()
    texts = defaultdict(set)
    want = sorted(
        (str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows()
    )
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == want
    for r in found:
        texts[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in texts.values())
    for k in range(16):
        slots = sorted(r["slot"] for r in found if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_rows_against_longest_first_one_by_one(spark):
    """Hot and rare texts, by every way a group can take to its rows and a class to its groups."""
    rng = random.Random(3)
    texts = ["x" * rng.randint(1, 60) + str(i) for i in range(900)]
    data = [(i, texts[0] if i % 3 == 0 else rng.choice(texts)) for i in range(3000)]
    sizes, of = Counter(), {}
    for _, text in data:
        sizes[text] += len(text) + 1
    want, loads = one_by_one(sizes.values(), 16)
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    for hot, ranked, broadcast in ((H.HOT, H.RANKED, H.BROADCAST), (0.01, 3, 0), (2.0, 5, H.BROADCAST), (0.0, 2, 0)):
        found = H.shard(docs, 16, hot, ranked, broadcast).collect()
        got, of = Counter(), {}
        for r in found:
            got[r["shard"]] += r["size"]
            of.setdefault(data[r["doc_id"]][1], set()).add(r["shard"])
        assert len(found) == len(data) and all(len(s) == 1 for s in of.values())
        assert dict(got) == loads
        assert Counter((sizes[t], next(iter(s))) for t, s in of.items()) == want
        assert len({(r["shard"], r["slot"]) for r in found}) == len(data)


def test_many_groups_shard_by_shard(spark):
    """200,000 groups of skewed sizes, a third of them of one size."""
    size = F.when(F.col("id") % 3 == 0, 77).otherwise(F.pow(F.pmod(F.xxhash64("id"), F.lit(90)) + 1, 2) + F.col("id") % 7)
    groups = spark.range(200_000).select(F.col("id").alias("group"), size.cast("bigint").alias("bytes")).cache()
    want, loads = one_by_one([r["bytes"] for r in groups.collect()], 16)
    for ranked, broadcast in ((H.RANKED, H.BROADCAST), (1000, 0)):
        placed = H.place(groups, 16, ranked, broadcast)
        found = placed.groupBy("bytes", "shard").agg(F.count(F.lit(1)).alias("n")).collect()
        assert {(r["bytes"], r["shard"]): r["n"] for r in found} == dict(want)
    groups.unpersist()
    assert max(loads.values()) - min(loads.values()) <= 8


def test_classes_against_the_heap():
    rng = random.Random(9)
    for shards in (1, 2, 7, 16):
        for _ in range(40):
            sizes = Counter(rng.choice((1, 2, 3, 50, rng.randint(1, 400))) for _ in range(rng.randint(1, 900)))
            want, _ = one_by_one(sizes.elements(), shards)
            dealt = H.longest_first(sorted(sizes.items(), reverse=True), shards)
            assert {(s, k): n for s, _, picks in dealt for k, n in picks.items()} == dict(want)


def test_one_group_above_a_shard(spark):
    dealt = list(H.longest_first([(1000, 1), (1, 300)], 4))
    assert dealt[0][2] == {0: 1} and dealt[1][2] == {1: 100, 2: 100, 3: 100}


def test_empty_table(spark):
    assert H.shard(nothing(spark)).collect() == []
