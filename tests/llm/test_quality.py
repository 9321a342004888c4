import zlib

import numpy as np

from tallyloom.llm import quality as Q
from tallyloom.llm.common import table

from .fixtures import documents, nothing, rows

DATA = "/root/testdata/sf0.1"


def test_linear_time_equals_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    model = {"bias": 0.3, "linear": rng.normal(size=50), "factors": rng.normal(size=(50, 4))}
    f, v = np.array([3, 7, 9, 20, 3, 8]), rng.normal(size=6)
    score, _ = Q.machine(model, f, v, np.array([0, 4]))
    for got, part in zip(score, (slice(0, 4), slice(4, 6))):
        ff, vv = f[part], v[part]
        want = model["bias"] + (model["linear"][ff] * vv).sum()
        for i in range(len(ff)):
            for j in range(i + 1, len(ff)):
                want += model["factors"][ff[i]] @ model["factors"][ff[j]] * vv[i] * vv[j]
        assert abs(got - want) < 1e-9


def test_held_out_accuracy(spark):
    scored = Q.score(table(spark, DATA, "documents"), table(spark, DATA, "labels")).toPandas()
    assert len(scored) == 10_000 and scored.score.between(0, 1).all()
    rest = scored.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    assert (rest == scored.held_out).all()
    labels = table(spark, DATA, "labels").toPandas()
    held = scored[scored.held_out].merge(labels, on="doc_id")
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert (good.predicted == 1).mean() >= 0.99 and (bad.predicted == 0).mean() >= 0.95
    order = held.score.rank()
    auc = (order[held.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert auc > 0.99


def test_awkward_rows_and_labels(spark):
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(60)] + [(1, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int"
    )
    scored = Q.score(documents(spark), labels).toPandas()
    assert len(scored) == len(rows()) and scored.score.between(0, 1).all() and scored.score.notna().all()
    kept = Q.drop_low_quality(documents(spark), labels)
    assert kept.columns == documents(spark).columns
    assert kept.count() == (scored.predicted == 1).sum()
    assert kept.schema == documents(spark).schema and Q.drop_low_quality(nothing(spark), labels).collect() == []
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan.replace("Exchange RoundRobinPartitioning", "")
    assert Q.score(nothing(spark), labels).collect() == []


def test_without_usable_labels(spark):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in Q.score(documents(spark), empty).collect()} == {1.0}
    one_kind = spark.createDataFrame([(i, 0, 0) for i in range(9)], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in Q.score(documents(spark), one_kind).collect()} == {0.0}
