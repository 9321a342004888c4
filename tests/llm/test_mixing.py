import hashlib
import re
from collections import defaultdict

from tallyloom.llm import mixing as M

from .fixtures import documents, nothing, rows


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def hash_of(doc_id, text):
    inner = hashlib.md5((text or "").encode()).hexdigest()
    name = ("" if doc_id is None else str(doc_id)) + ":" + inner
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)


def loop_targets(sizes):
    """Share by weight, cap, and share what is left again until nothing is above its cap."""
    names = sorted((s for s in sizes), key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)


def test_against_a_loop_over_sorted_hashes(spark):
    docs = [(r[0], size(r[1]), r[3], hash_of(r[0], r[1])) for r in rows()]
    sizes = defaultdict(int)
    for _, n, s, _ in docs:
        sizes[s] += n
    target = loop_targets(dict(sizes))
    want = []
    for s in sizes:
        whole = min(3, int(target[s] // sizes[s])) if sizes[s] else 0
        budget, before = target[s] - whole * sizes[s], 0
        units = defaultdict(list)
        for d, n, source, h in docs:
            if source == s:
                units[h].append((d, n))
        for h in sorted(units):
            n = sum(x for _, x in units[h])
            extra = budget > 0 and before + n <= budget or (0 < budget and before <= budget and 2 * (budget - before) >= n)
            before += n
            want += [(str(d), x, sizes[s], round(target[s], 6), x * (whole + (whole < 3 and extra))) for d, x in units[h]]
    df = M.mix(documents(spark))
    got = [(str(r[0]), r[1], r[2], round(r[3], 6), r[4]) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(got) == sorted(want)


def test_small_source_is_taken_three_times_and_the_rest_reshared(spark):
    data = [(i, "w " * 10, "a" if i == 0 else "b" if i < 50 else "c") for i in range(90)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    got = {r["source_size"]: r["target"] for r in M.mix(docs).collect()}
    assert got[10] == 30.0
    assert abs(sum({k: v for k, v in got.items()}.values()) - 900) < 1e-6


def test_stage_repeats_rows_as_often_as_taken(spark):
    taken = {}
    for r in M.mix(documents(spark)).collect():
        if r["size"] and r["doc_id"] is not None and r["doc_id"] < 200:
            taken[r["doc_id"]] = r["taken"] // r["size"]
    mixed = M.apply_mix(documents(spark))
    assert mixed.columns == documents(spark).columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in counts.items() if i is not None and i < 200}


def test_empty_table(spark):
    assert M.mix(nothing(spark)).collect() == []
    assert M.apply_mix(nothing(spark)).collect() == []


def test_reruns_agree(spark):
    first, second = (sorted(map(str, M.mix(documents(spark)).collect())) for _ in range(2))
    assert first == second
