import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from tallyloom.llm import packing as P

from .fixtures import documents, nothing, rows

ALPHABET = [
    "a", "B", "é", "ß", " ", "  ", "\n", "\t", "\r\n", " \n", "'", "s", "'LL", "1", "²", "½", "٣", ".", "--", "…", "日本",
    "é", "\x1c", "\x85", "\xa0", "　", "😀", "<|endoftext|>", "_", "|", "the", " and", "\x00", "​",
]


def reference():
    tokenizer = Tokenizer.from_file(P.default_tokenizer())
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_wordwise_ids_are_those_of_the_tokenizer():
    tokenizer, words, rng = reference(), P.WordwiseEncoder(P.default_tokenizer()), random.Random(3)
    assert words.merge is not None
    for _ in range(4000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode(text), "<u4").tolist() == want, repr(text)


def test_pieces():
    assert P.piece_bounds(1) == [(0, 1)]
    assert P.piece_bounds(1024) == [(0, 1024)]
    assert P.piece_bounds(1025) == [(0, 1), (1, 1024)]
    assert P.piece_bounds(3000) == [(0, 952), (952, 1024), (1976, 1024)]


def loop_best_fit(lengths, sequence):
    """Best-fit decreasing, one piece at a time."""
    gaps = Counter()
    bins = 0
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n and gaps[g]), default=None)
        if fit is None:
            bins, fit = bins + 1, sequence
        else:
            gaps[fit] -= 1
        gaps[fit - n] += 1
    return bins


def test_rounds_are_valid_and_as_tight_as_one_piece_at_a_time():
    rng = random.Random(4)
    for sequence in (10, 64, 1024):
        for _ in range(20):
            lengths = [min(sequence, max(1, int(rng.expovariate(3 / sequence)))) for _ in range(rng.randint(1, 600))]
            counts = Counter(lengths)
            plan = P.best_fit_rounds(counts, sequence)
            filled, taken = {}, Counter()
            spans = []
            for length, rank, number, first, offset in plan:
                taken[length] += number
                spans += [(first + i, offset, length) for i in range(number)]
            assert taken == counts
            for where, offset, length in sorted(spans):
                assert filled.get(where, 0) == offset
                filled[where] = offset + length
            assert max(filled.values()) <= sequence
            assert sorted(filled) == list(range(len(filled)))
            assert len(filled) <= loop_best_fit(lengths, sequence) + 1


def test_every_piece_of_awkward_documents(spark):
    tokenizer = reference()
    found = P.pack(documents(spark)).toPandas()
    want = Counter()
    for r in rows():
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for k, (start, length) in enumerate(P.piece_bounds(len(ids))):
            want[-1 if r[0] is None else r[0], k, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    found["doc_id"] = found.doc_id.fillna(-1).astype(int)
    got = Counter(found[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    assert got == want
    found = found.sort_values(["sequence_id", "offset"])
    by = found.groupby("sequence_id").length
    assert (by.cumsum() - found.length == found.offset).all() and by.sum().max() <= 1024
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 1024) + 1


def test_empty_table(spark):
    assert P.pack(nothing(spark)).collect() == []


def test_added_tokens_are_those_of_an_untouched_tokenizer(spark):
    tokenizer = Tokenizer.from_file(P.default_tokenizer())
    words, rng = P.WordwiseEncoder(P.default_tokenizer(), added=True), random.Random(6)
    texts = ["end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b", "<|endoftext|", "< |endoftext|>"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [437, 220, 50256, 1306]
    for text, ids in zip(texts, want):
        assert np.frombuffer(words.encode(text), "<u4").tolist() == ids, repr(text)
    docs = spark.createDataFrame(list(enumerate(texts[:300])), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in P.pack(docs).collect()}
    crc = [zlib.crc32(np.array([*ids, 2], dtype="<u4").tobytes()) for ids in want[:300]]
    assert got == {i: (len(want[i]) + 1, crc[i]) for i in range(300)}
