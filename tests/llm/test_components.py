import random

from tallyloom.llm.common import components, gapless_rank


def test_components_of_a_path_a_star_and_random_links(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 120)] + [(200, 200 + i) for i in range(1, 150)]
    edges += [(rng.randint(400, 600), rng.randint(400, 600)) for _ in range(120)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_ranks_have_no_gaps_in_a_hot_key(spark):
    data = [("hot" if i % 3 else None, i % 7, i) for i in range(500)]
    ranked = gapless_rank(spark.createDataFrame(data, "k string, a int, b int"), ["k"], ["a", "b"], 50).collect()
    for key in ("hot", None):
        ranks = sorted(r["rank"] for r in ranked if r["k"] == key)
        assert ranks == list(range(sum(d[0] == key for d in data)))
