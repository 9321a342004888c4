import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import chat as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, codes string, entry int"


def brute(codes):
    """Least cost over all ways, by trying them."""
    best = [C._NEVER]

    def go(i, state, cost):
        if cost >= best[0]:
            return
        if i == len(codes):
            best[0] = min(best[0], cost + C.INSERT * C._TO_END[state])
            return
        for to in (C.SYSTEM, C.USER, C.ASSISTANT):
            change = C.RELABEL * (codes[i] != to)
            if to == state:
                go(i + 1, to, cost + change + C.MERGE)
            if C._STEPS[state, to] < C._NEVER:
                go(i + 1, to, cost + change + C.INSERT * int(C._STEPS[state, to] - 1))

    go(0, C.START, 0)
    return best[0]


def conversations():
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "User ", None, "tool"]
    rows = []
    for conv in range(40):
        rows += [(conv, t, rng.choice(roles), f"c{conv} t{t}") for t in range(rng.randint(1, 7))]
    rows += [(50, t, ("user", "assistant")[t % 2], "long") for t in range(1500)]  # longer than a segment
    rows += [(51, 0, "user", "same")] * 3  # repeated rows
    rows += [(52, None, "user", None), (52, 1, "system", ""), (None, 0, "user", "no id"), (None, 1, "user", "x")]
    return [(*r, 1, "x", 2) for r in rows]


def test_tables_give_the_least_cost():
    rng = random.Random(1)
    for _ in range(150):
        codes = bytes(rng.randrange(4) for _ in range(rng.randint(1, 6)))
        costs = C.segment_table(codes)[C.START]
        assert min(costs[s] + C.INSERT * C._TO_END[s] for s in range(4)) == brute(codes)


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_every_conversation_becomes_legal_at_least_cost(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = C.repair(spark.createDataFrame(conversations(), SCHEMA).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    given = {}
    for r in conversations():
        given.setdefault(r[0], []).append(r)
    assert {r["conv_id"] for r in found} == set(given)
    for conv, turns in given.items():
        turns.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or ""))
        mine = sorted((r for r in found if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(len(turns)))
        assert [r["role"] for r in mine] == [t[2] for t in turns]
        text = "".join(r["rendered"] for r in mine)
        roles = "".join(f"{m} " for m in re.findall(r"<\|im_start\|>(\w+)\n", text))
        assert re.fullmatch("(system )?(user assistant )*", roles)
        assert text.count("<|im_start|>") == text.count("<|im_end|>\n") and text.endswith("<|im_end|>\n")
        assert all(t[3] in text for t in turns if t[3])
        if len(turns) < 10:
            assert sum(r["cost"] for r in mine) == brute([C._code(t[2]) for t in turns])


def test_long_turns_make_short_segments(spark):
    """Turns of a million characters: rows stay small, and the repair is the same as that of short turns."""
    size, turns = C.SEGMENT_CHARS // 4, 30
    role = F.when(F.col("id") % 3 == 0, "assistant").otherwise("user")
    base = spark.range(turns).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"))
    long, short = (base.withColumn("text", F.repeat(F.lit("x"), n)) for n in (size, 1))
    order = ["conv_id", "turn"]
    segments = long.repartition(1).sortWithinPartitions(*order).mapInArrow(C._segments, C._SEGMENT_DDL)
    held = [r["n"] for r in segments.select(F.size("turns").alias("n")).collect()]
    assert sum(held) == turns and max(held) <= 4
    kept = ["position", "turn", "role", "action", "new_role", "inserted", "inserted_at_end", "cost"]
    one, two = (sorted(map(tuple, C.repair(df).select(*kept).collect())) for df in (long, short))
    assert one == two and len(one) == turns


def test_whole_conversations_and_empty_table(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", 1, "", 0), (1, 1, "user", "b", 1, "", 0)], SCHEMA)
    row = C.render_conversations(turns).first()
    assert row["rendered"] == "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert row["cost"] == C.MERGE + C.INSERT
    assert C.repair(spark.createDataFrame([], SCHEMA)).collect() == []
