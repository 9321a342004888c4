"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents become pieces of at most one sequence. Pieces and gaps are kept sorted by size, in classes:
whatever the corpus, there are at most as many classes as a sequence has tokens, so what the rounds
pass around is one count per class. A round takes the longest pieces left; they sweep the gaps from
their own size upwards (the successor first); where more pieces want a gap than there are, the
lower ranks win and the others go on to the next one; what finds no gap opens new sequences; then
the gaps are updated. The rounds fix which ranks of a class meet which run of sequences, and every
piece finds its sequence by its rank in one distributed join. No piece visits the driver.

Defined results: null text is an empty document, which still holds the end token. The string of an added
token in a text is that token, as for the tokenizer without ``add_special_tokens``. Repeated rows are
packed as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import binary_text, gapless_rank, slices, table
from tallyloom.session import ship_package, store

SEQUENCE, END_ID = 1024, 2
#: Distinct words whose ids a task remembers.
REMEMBERED = 300_000
#: White space that cannot stand before a word as its one space.
_BREAK = re.compile(r"(\s\s+|[^\S ])")
#: Parts of a word that byte-level vocabularies never merge across. No apostrophe: contractions differ.
_PARTS = re.compile(r"[^\W\d_]+|[0-9]+|[!-&(-/:-@\[-`{-~]+")
#: White space for Python only.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Words(dict):
    """Ids of words as packed 32-bit integers; what is not known yet is encoded when asked for."""

    def __init__(self, space: str, merge, other):
        super().__init__()
        self.space, self.merge, self.other = space, merge, other
        self.marks = {m: array("I", merge(m.encode())).tobytes() for m in ".,;:!?"} if merge else {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if word.isalpha():
            found = array("I", self.merge((self.space + word).encode())).tobytes()
        elif word[-1:] in self.marks and word[:-1].isalpha():
            found = self[word[:-1]] + self.marks[word[-1]]
        else:
            found = self.other(self.space, word)
        self[word] = found
        return found


class WordwiseEncoder:
    """Ids as packed 32-bit integers, looked up word by word.

    A byte-level vocabulary splits text before merging, and a single space between two other
    characters always starts a new part. So the words between such spaces can be encoded apart, and
    many of them have been met before. Of a run of white space the last character stands before the
    next word if it is a space, and alone if not; the others are one part.

    Where the merges of the vocabulary are in the order of the ids, parts of letters, digits or marks
    are merged by ``tiktoken`` from the same file, which is quicker; all else goes to ``tokenizers``.

    With ``added``, as in packing, the string of an added token (``<|endoftext|>``) is that token wherever
    it stands, as the tokenizer file has it; a text that holds one goes to ``tokenizers`` as a whole.
    Without, the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.merge = self._merger(path)
        self.spaced = _Words(" ", self.merge, self.word)
        self.bare = _Words("", self.merge, self.word)

    @staticmethod
    def _merger(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            loaded = json.load(file)
        vocabulary, merges = loaded["model"]["vocab"], loaded["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        made = [vocabulary.get("".join(p), -1) for p in pairs]
        splitter = (loaded.get("pre_tokenizer") or {}).get("type")
        if splitter != "ByteLevel" or loaded.get("normalizer") or made != list(range(256, 256 + len(made))):
            return None
        letters = _byte_letters()
        ranks = {
            bytes(letters[c] for c in token): i
            for token, i in vocabulary.items()
            if i < 256 + len(made) and all(c in letters for c in token)
        }
        core = tiktoken.Encoding("packing", pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return core.encode_single_piece

    def general(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def part(self, text: str) -> bytes:
        return array("I", self.merge(text.encode())).tobytes()

    def word(self, space: str, word: str) -> bytes:
        if not word:
            return self.part(space) if space else b""
        parts = _PARTS.findall(word)
        if sum(map(len, parts)) != len(word) or not all(p.isalpha() or p.isascii() for p in parts):
            return self.general(space + word)
        return self.part(space + parts[0]) + b"".join(map(self.part, parts[1:]))

    def encode(self, text: str) -> bytes:
        if self.merge is None or any(c in text for c in (*_SEPARATORS, *self.added)):
            return self.general(text)
        out, head = [], self.bare
        pieces = _BREAK.split(text)
        for at in range(0, len(pieces), 2):
            first, *rest = pieces[at].split(" ")
            if first or head is self.bare:
                out.append(head[first])
            out += map(self.spaced.__getitem__, rest)
            if at + 1 < len(pieces):
                run, head = pieces[at + 1], self.bare
                if at + 2 == len(pieces) - 1 and not pieces[at + 2]:
                    out.append(self.part(run))  # at the end of the text a run is one part
                    break
                if len(run) > 1:
                    out.append(self.part(run[:-1]))
                if run[-1] == " ":
                    head = self.spaced
                else:
                    out.append(self.part(run[-1]))
        return b"".join(out)


@lru_cache(maxsize=1)
def encoder(path: str) -> WordwiseEncoder:
    """One per worker process."""
    return WordwiseEncoder(path, added=True)


def piece_bounds(length: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces; all but the first fill a sequence."""
    first = length % sequence or sequence
    return [(0, min(first, length))] + [(s, sequence) for s in range(first, length, sequence)]


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def _pieces(path: str, sequence: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, "_text"):
            ids = batch.column("doc_id").to_pylist()
            encoded = [words.encode(t.decode("utf-8", "replace")) for t in batch.column("_text").to_pylist()]
            rows = []
            for doc, packed in zip(ids, encoded):
                packed += end
                for k, (start, length) in enumerate(piece_bounds(len(packed) // 4, sequence)):
                    rows.append((doc, k, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)])))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return run


def best_fit_rounds(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): which ranks of a class go to which sequences.

    Rank first + i goes to sequence first + i. A sequence of n tokens gives at most about n ln n rows
    for new sequences, plus one for each run of gaps that a class uses.
    """
    gaps: dict[int, deque] = defaultdict(deque)  # size -> runs of (first sequence, number)
    sizes: list[int] = []  # sizes that have gaps, ascending
    plan, opened = [], 0

    def leave(size: int, first: int, number: int) -> None:
        if size:
            if not gaps[size]:
                insort(sizes, size)
            gaps[size].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)  # the successor: the smallest gap that holds the piece
            if at == len(sizes):
                break
            size = sizes[at]
            first, number = gaps[size].popleft()
            used = min(number, left)
            plan.append((length, rank, used, first, sequence - size))
            if used < number:
                gaps[size].appendleft((first + used, number - used))
            elif not gaps[size]:
                del sizes[at]
            leave(size - length, first, used)
            rank, left = rank + used, left - used
        per = sequence // length
        for number, fill in ((left // per, per), (1, left % per)):
            if not number or not fill:
                continue
            for k in range(fill):
                plan.append((length, rank, number, opened, k * length))
                rank += number
            leave(sequence - fill * length, opened, number)
            opened += number
    return plan


def token_pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    ship_package(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), binary_text().alias("_text"))
    return source.mapInArrow(
        _pieces(path, sequence, end_id), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece with the sequence and the offset where it lies."""
    spark = docs.sparkSession
    pieces = store(token_pieces(docs, path or default_tokenizer(), sequence, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(
        best_fit_rounds(counts, sequence),
        "length bigint, first_rank bigint, number bigint, first_sequence bigint, offset bigint",
    )
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"])
    here = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("number"))
    # The plan depends on the length of a sequence, not on the corpus.
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & here)
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset",
    )


def op4(spark: SparkSession, directory: str) -> DataFrame:
    return pack(table(spark, directory, "documents"))


QUERIES = {"op4_best_fit_packing": op4}
