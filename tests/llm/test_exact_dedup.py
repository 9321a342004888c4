import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from tallyloom.llm import exact_dedup as X

from .fixtures import documents, nothing, rows


def plain(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def expected():
    groups = defaultdict(list)
    for r in rows():
        groups[plain(r[1])].append(r[0])
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        stays = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            kept = i == keep and stays
            stays = stays and not kept
            out[i, keep, len(ids), kept, sha] += 1
    return out


@pytest.mark.parametrize("id_bytes", [16, 1])
def test_groups_are_those_of_equal_normalised_texts(spark, id_bytes):
    """With names of one byte, chunks that share a name must still be told apart."""
    df = X.exact_groups(documents(spark), id_bytes)
    found = Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert found == expected()


def test_stage_keeps_one_row_of_each_text_with_its_columns(spark):
    docs = documents(spark)
    kept = X.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [plain(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({plain(r[1]) for r in rows()})


def test_empty_table(spark):
    assert X.exact_groups(nothing(spark)).collect() == []
    assert X.drop_exact_duplicates(nothing(spark)).collect() == []


def test_chunks_rejoin_to_the_text_and_follow_content():
    rng = random.Random(1)
    body = bytes(rng.randrange(97, 123) for _ in range(60_000))
    a, b = X.cut_points([body, b"some words before " + body])
    assert a[-1] == len(body) and a == sorted(set(a))
    sizes = [y - x for x, y in zip([0, *a], a)]
    assert max(sizes) <= X.MAX_CHUNK and min(sizes[:-1]) >= X.MIN_CHUNK
    chunks = {body[x:y] for x, y in zip([0, *a], a)}
    moved = b"some words before " + body
    shared = [moved[x:y] for x, y in zip([0, *b], b) if moved[x:y] in chunks]
    assert sum(map(len, shared)) > 0.8 * len(body)
    assert X.cut_points([b"", b"a"]) == [[], [1]]
    assert X.cut_points([b"\x00" * 50_000])[0][-1] == 50_000


@pytest.mark.parametrize("text", [b"", b" ", b"\n\n", b" a", b"a ", b"a \t b", b"\x0ba\x0c", "é ü".encode()])
def test_normalise(text):
    assert X.normalise(text) == plain(text.decode()).encode()
