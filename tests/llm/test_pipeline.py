"""The pipeline and the registered queries, held against plain loops."""

import zlib
from collections import Counter, defaultdict

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline as P
from tallyloom.llm import mixing, packing, quality
from tallyloom.llm.common import table

from .fixtures import documents, rows
from .test_exact_dedup import plain
from .test_mixing import hash_of, loop_targets, size
from .test_packing import reference
from .test_simhash import loop_fingerprint

DATA = "/root/testdata/sf0.001"


def loop_near(docs):
    """Union over all pairs of fingerprints; the smallest id of each group stays."""
    fps = np.array([loop_fingerprint(d[1]) for d in docs], dtype=np.uint64)
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3):
            old, new = root[i], root[j]
            root = [new if r == old else r for r in root]
    least = {}
    for d, r in sorted(zip(docs, root)):
        least.setdefault(r, d)
    return sorted(least.values())


def loop_mix(docs):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += size(text)
    target, out = loop_targets(dict(sizes)), Counter()
    for s in sizes:
        whole = min(3, int(target[s] // sizes[s])) if sizes[s] else 0
        budget, before = target[s] - whole * sizes[s], 0
        for h, d in sorted((hash_of(i, t), (i, t)) for i, t, source in docs if source == s):
            n = size(d[1])
            extra = before + n <= budget or (before <= budget and 2 * (budget - before) >= n)
            before += n
            out[d] += whole + (budget > 0 and whole < 3 and extra)
    return out


def test_run_against_loops(spark):
    scored = {r["doc_id"]: r["predicted"] for r in quality.score(table(spark, DATA, "documents"), table(spark, DATA, "labels")).collect()}
    docs = [tuple(r) for r in table(spark, DATA, "documents").select("doc_id", "text", "source").collect()]
    docs = [d for d in docs if scored[d[0]]]
    first = {}
    for d in sorted(docs):
        first.setdefault(plain(d[1]), d)
    taken = loop_mix(loop_near(list(first.values())))
    tokenizer, want = reference(), Counter()
    for (doc, text), copies in taken.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for k, (start, length) in enumerate(packing.piece_bounds(len(ids))):
            want[doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())] += copies
    found = P.run(spark, DATA).toPandas()
    got = Counter(found[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    assert got == +want
    found = found.sort_values(["sequence_id", "offset"])
    by = found.groupby("sequence_id").length
    assert (by.cumsum() - found.length == found.offset).all() and by.sum().max() <= 1024


def test_stages_keep_the_columns_and_take_awkward_rows(spark, tmp_path):
    docs = documents(spark)
    columns, counts = docs.columns, [len(rows())]
    for name, stage in P.STAGES:
        docs = stage(spark, docs, DATA)
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
        counts.append(docs.count())
    assert counts[1] <= counts[0] and counts[3] < counts[2] < counts[1]


def test_every_operator_is_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert names["pipeline"] is P.run and "pipeline" not in entry.oracle_sql()


def test_queries_with_sql_agree_with_it(spark):
    from check_oracle import compare, connect

    con = connect(DATA)
    for name in ("op1_exact_dedup", "op3_mix_sources", "op13_importance_resampling"):
        assert compare(entry.queries()[name](spark, DATA), con, entry.oracle_sql()[name]) == []
    assert mixing.SQL
