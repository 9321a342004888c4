import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import importance as I
from tallyloom.llm.common import table

from .fixtures import SCHEMA, documents, nothing, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def loop(docs, target, max_words=1, percent=I.PERCENT, min_words=I.MIN_WORDS, buckets=I.BUCKETS):
    """The whole rule with plain dictionaries; docs are (doc_id, text)."""

    def found(text):
        words = words_of(text)
        runs = [" ".join(words[i : i + n]) for n in range(1, max_words + 1) for i in range(len(words) - n + 1)]
        return [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in found(text):
            s[b] += 1
    for text in target:
        for b in found(text):
            t[b] += 1
    total_s, total_t = sum(s), sum(t)
    out, usable = [], []
    for place, (doc_id, text) in enumerate(docs):
        own = found(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in own]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, None])
        if len(words_of(text)) >= min_words:
            usable.append(place)
    usable.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for rank, place in enumerate(usable[: percent * len(usable) // 100], start=1):
        out[place][4] = rank
    return sorted((tuple(r) for r in out), key=str)


def spark_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_combined_crcs():
    rng = np.random.default_rng(1)
    pieces = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(0, 400, (200, 2))]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], dtype=np.uint32)
    got = I.combine(crc(a for a, _ in pieces), crc(b for _, b in pieces), np.array([len(b) for _, b in pieces]))
    assert (got == crc(a + b for a, b in pieces)).all()


@pytest.mark.parametrize("max_words", [1, 3])
def test_features_against_plain_words(max_words):
    texts = ["", "one", "The the THE ünïcode-ÄÖ 日本 語\x00x", "a b c a b c", "...", "w" * 3000 + " end", "x y z"]
    got = [(int(t), int(c)) for text, crc in I.features([t.encode() for t in texts], max_words) for t, c in zip(text, crc)]
    expected = []
    for k, text in enumerate(texts):
        w = words_of(text)
        expected += [(k, zlib.crc32(" ".join(w[i : i + n]).encode())) for n in range(1, max_words + 1) for i in range(len(w) - n + 1)]
    assert sorted(got) == sorted(expected)
    assert list(I.features([], max_words))[0][0].size == 0


@pytest.mark.parametrize("max_words,percent", [(1, 10), (2, 45)])
def test_awkward_rows(spark, max_words, percent):
    docs = documents(spark)
    target = spark.createDataFrame([("the anea thing",), (None,), ("ing ing",)], "text string")
    got = I.resample(docs, target, percent=percent, max_words=max_words)
    plain = loop([(r[0], r[1]) for r in rows()], ["the anea thing", None, "ing ing"], max_words, percent)
    # Copies under one id have one score: their ranks may be dealt in any order.
    assert spark_rows(got) == plain


def test_empty_tables(spark):
    texts = spark.createDataFrame([("the thing",)], "text string")
    assert I.resample(nothing(spark), texts).collect() == []
    some = spark.createDataFrame(rows()[:30], SCHEMA)
    assert spark_rows(I.resample(some, texts.limit(0))) == loop([(r[0], r[1]) for r in rows()[:30]], [])


def test_drawn_documents_are_closer_to_the_target(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = I.op13(spark, "/root/testdata/sf0.01")
    means = {r["drawn"]: r["w"] for r in found.join(docs.select("doc_id", "n_chars"), "doc_id").filter("n_features >= 20")
             .groupBy(F.col("rank").isNotNull().alias("drawn")).agg(F.avg("weight").alias("w")).collect()}
    assert means[True] > means[False]
