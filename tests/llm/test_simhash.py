import re
from collections import Counter

import numpy as np
import xxhash

from tallyloom.llm import simhash as S
from tallyloom.llm.local import Links

from .fixtures import documents, nothing, rows


def loop_fingerprint(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def loop_components(fps, near):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if near(fps[i], fps[j]) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def test_components_of_awkward_documents(spark):
    docs = rows()
    fps = [loop_fingerprint(r[1]) for r in docs]
    root = loop_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    want = Counter()
    for r, fp, k in zip(docs, fps, root):
        ids = [d[0] for d, other in zip(docs, root) if other == k and d[0] is not None]
        want[r[0], fp, min(ids, default=None)] += 1
    # Tiles of four, so that cells are split.
    for tile in (S.TILE, 4):
        found = S.near_groups(documents(spark), tile=tile)
        got = Counter((r[0], int(r[1].hex(), 16), r[2]) for r in found.select("doc_id", "fp", "component_id").collect())
        assert got == want


def test_tiles_link_all_close_pairs_of_many_fingerprints(spark):
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    for _ in range(3):
        flips = np.uint64(1) << rng.integers(0, 64, (400, 3), dtype=np.uint64)
        fps = np.unique(np.concatenate((fps, fps[rng.integers(0, len(fps), 400)] ^ np.bitwise_xor.reduce(flips, axis=1))))
    whole = Links(len(fps))
    for i in range(len(fps)):
        near = i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3)
        whole.add(np.full(len(near), i), near)
    node, root = whole.stars()
    want = dict(zip(node.tolist(), root.tolist()))
    got_node, got_root = S.close_pairs(fps[:, None], None)
    assert dict(zip(got_node.tolist(), got_root.tolist())) == want
    # Dealt to tiles in Spark, the links join the same fingerprints.
    names = [bytes(x) for x in fps.astype(">u8").view(np.uint8).reshape(-1, 8)]
    frame = spark.createDataFrame([(x,) for x in names], "fp binary")
    dealt = S.tile_pairs(frame, S.STRICT, 500).repartition("lo", "hi").sortWithinPartitions("lo", "hi")
    edges = dealt.mapInArrow(S._compare(S.STRICT), "a binary, b binary").collect()
    place = {x: i for i, x in enumerate(names)}
    joined = Links(len(fps))
    joined.add(np.array([place[bytes(e[0])] for e in edges]), np.array([place[bytes(e[1])] for e in edges]))
    node, root = joined.stars()
    assert dict(zip(node.tolist(), root.tolist())) == want


def test_stage_keeps_one_of_each_group(spark):
    docs = documents(spark)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    # One of each group, the smallest id; copies, and rows that repeat, are a group of their own at least.
    root = loop_components([loop_fingerprint(r[1]) for r in rows()], lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for k, r in zip(root, rows()):
        first[k] = min(first.get(k, (True, 0)), (r[0] is None, r[0] or 0))
    assert ids == Counter(None if no_id else i for no_id, i in first.values())
    assert [i for i in ids if i is not None and 100 <= i < 140] == [100]
    assert sum(ids[i] for i in (200, 201, 202)) == 1 and ids[200] == 1
    assert ids[206] == 1 and ids[207] == 2 and ids[None] == 1


def test_more_words_estimate_the_similarity():
    rng = np.random.default_rng(4)
    measure = S.SIMILAR
    linked = {0.5: 0, 0.9: 0}
    for share in linked:
        for _ in range(60):
            common = int(400 * 2 * share / (1 + share))
            pool = rng.integers(0, 2**64, 800 - common, dtype=np.uint64)
            both = [pool[:400], np.concatenate((pool[:common], pool[400:]))]
            fps = S.majority_bits([x.astype(">u8").tobytes() for x in both], measure.words)
            linked[share] += len(S.close_pairs(fps, None, measure)[0])
    assert linked[0.5] == 0 and linked[0.9] >= 58


def test_empty_table(spark):
    assert S.near_groups(nothing(spark)).collect() == []
    assert S.drop_near_duplicates(nothing(spark)).collect() == []


def test_local_components_after_compaction():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    whole, parts = Links(300), Links(300, most=10)
    whole.add(a, b)
    for i in range(200):
        parts.add(a[i : i + 1], b[i : i + 1])
    assert [x.tolist() for x in whole.stars()] == [x.tolist() for x in parts.stars()]


def test_stage_is_that_of_a_brute_force_on_bits(spark):
    """Long texts with few words changed, texts cut short, copies, and a chain of small changes."""
    rng = np.random.default_rng(12)

    def words(n):
        return [f"w{x}" for x in rng.integers(0, 10**9, n)]

    texts = []
    for k in range(60):
        base = words(60 + 20 * k)
        texts += [base, [*base[:-1], "other"], base[: len(base) - k % 7], [w.upper() for w in base]]
    chain = words(900)
    for _ in range(12):
        at = int(rng.integers(0, 900))
        chain = [*chain[:at], "new", *chain[at + 1 :]]
        texts.append(chain)
    texts = [" ".join(t) for t in texts] + ["", None, "  "]
    root = loop_components([loop_fingerprint(t) for t in texts], lambda a, b: (a ^ b).bit_count() <= 3)
    want = sorted({root.index(r) for r in root})
    assert 60 < len(want) < len(texts) - 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in S.drop_near_duplicates(docs).collect()) == want
    # Tiles of eight, so that cells are split.
    groups = S.near_groups(docs, tile=8).filter("kept").collect()
    assert sorted(r["doc_id"] for r in groups) == want
