import hashlib
import zlib

import numpy as np
import pytest

from tallyloom.llm import periodic as P
from tallyloom.llm.common import table
from tallyloom.llm.recompression import common_extension, grammar, mirror

from .fixtures import documents, nothing, rows


def loop_runs(words, least=12):
    """Every stretch whose words equal the words p further on, by plain comparison."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            if i > start and length >= max(least, 2 * p):
                found.setdefault((start, length), p)
            i += i == start
    return sorted((s, n, p) for (s, n), p in found.items())


def loop_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(loop_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def awkward_texts(rng):
    out = []
    for _ in range(rng.integers(1, 6)):
        n = int(rng.integers(0, 120))
        text = rng.integers(0, rng.integers(1, 5), n)
        if n > 10 and rng.random() < 0.6:
            a = int(rng.integers(0, n))
            p = 1 + int(rng.integers(0, max(1, (n - a) // 2)))
            at = np.arange(n)
            text = text[np.where(at < a, at, a + (at - a) % p)]
        out.append(text)
    return out


def test_extensions_against_loops():
    rng = np.random.default_rng(3)
    for _ in range(100):
        text = np.concatenate([[-1], *awkward_texts(rng), [-2]])
        if len(text) < 4:
            continue
        i = rng.integers(1, len(text) - 1, 50)
        j = rng.integers(1, len(text) - 1, 50)
        i, j = i[i != j], j[i != j]
        levels = grammar(text)
        last = len(text) - 1
        ahead = common_extension(levels, i, j)
        back = common_extension(mirror(levels), last - i, last - j)
        for a, b, f, r in zip(i, j, ahead, back):
            k = 0
            while text[a + k] == text[b + k]:
                k += 1
            assert f == k
            k = 0
            while text[a - k] == text[b - k]:
                k += 1
            assert r == k


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_against_loops(least, monkeypatch):
    rng = np.random.default_rng(least)
    for trial in range(150):
        monkeypatch.setattr(P, "PLACES", int(rng.choice([1, 7, 1000])))
        texts = awkward_texts(rng)
        expected = [(k, *r) for k, t in enumerate(texts) for r in sorted(loop_runs(t.tolist(), least), key=lambda r: (r[0], r[2]))]
        assert [tuple(r) for r in P.find_runs(texts, least).tolist()] == expected


def test_long_texts():
    assert P.find_runs([np.zeros(200_000, dtype=int)]).tolist() == [[0, 0, 200_000, 1]]
    assert P.find_runs([np.arange(50_000) % 7_001, np.arange(30)]).tolist() == [[0, 0, 50_000, 7_001]]
    assert P.find_runs([]).tolist() == []


def test_given_documents_against_loops(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    found = P.op11(spark, "/root/testdata/sf0.001").collect()
    texts = docs.select("doc_id", "text").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted((tuple(r) for r in found), key=key) == sorted((loop_row(*r) for r in texts), key=key)
    assert sum(r["n_runs"] > 0 for r in found) > 10


def test_awkward_rows(spark, monkeypatch):
    found = P.digest(P.periodic_runs(documents(spark), planted=True)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    expected = [loop_row(r[0], r[1]) for r in rows() if r[0] != 204]
    assert sorted((tuple(r) for r in found if r[0] != 204), key=key) == sorted(expected, key=key)
    assert len(found) == len(rows())
    assert P.digest(P.periodic_runs(nothing(spark))).collect() == []
