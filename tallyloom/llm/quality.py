"""Quality score by a factorisation machine.

Features of a text: its words, hashed; its structure (shares of kinds of characters, line and word
lengths, repetition) and its metadata (n_chars), each as one of a few steps. Steps and words interact
pairwise through vectors of a low rank. The sum over all pairs is taken in linear time as half the
square of the sum less the sum of the squares.

The machine is fitted on a bounded sample of labelled rows (``MAX_TRAIN``), in one task; the sample is
drawn by hash. Everything is scored, whole. Language, source and id are never inputs.

Defined results: null text counts as empty and is scored by its structure; a null n_chars is a step
of its own. Several labels of one document are averaged. With no usable label, or labels of one kind
only, every score is the share of good labels (1 without labels). An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import binary_text, doc_crc, slices, table
from tallyloom.session import ship_package

WORD_BITS, STEPS, RANK = 15, 20, 8
WORD_MASS = 4.0
#: Labelled rows that a fit reads at most.
MAX_TRAIN = 12_000
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.08, 1e-4
#: Words a task remembers the place of.
REMEMBERED = 500_000

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BLANK = b" \t\n\r\x0b\x0c"
N_STRUCTURE = 18
SIZE = (1 << WORD_BITS) + N_STRUCTURE * STEPS


def structure(text: bytes, words: list[bytes], n_chars: int | None) -> list[float]:
    """Shares and lengths, each scaled to 0..1."""
    n = max(1, len(text))

    def share(kind: bytes) -> float:
        return (len(text) - len(text.translate(None, kind))) / n

    lines = text.split(b"\n")
    count = max(1, len(words))
    letters = share(_UPPER) + share(_LOWER)
    def often(*parts: bytes) -> float:
        """Occurrences per word; the root tells small shares apart as well as large ones."""
        return min(1.0, math.sqrt(sum(map(text.count, parts)) / count))

    return [
        min(1.0, math.log1p(len(text)) / 14),
        math.sqrt(share(_UPPER) / max(1e-9, letters)),
        math.sqrt(share(_DIGIT)),
        math.sqrt(share(_MARKS)),
        math.sqrt(share(_BLANK)),
        math.sqrt(max(0.0, 1 - letters - share(_BLANK))),
        min(1.0, (len(text) / count) / 20),
        len(set(words)) / count,
        len(set(lines)) / len(lines),
        min(1.0, math.log1p(len(text) / len(lines)) / 10),
        math.sqrt(sum(map(eq, words, words[1:])) / count),
        often(b"|"),
        often(b"!", b"?"),
        often(b"#", b"$", b"%", b"&", b"*"),
        often(b".", b","),
        often(b"http"),
        often(b"<", b">", b"{", b"}"),
        0.0 if n_chars is None else min(1.0, 0.1 + math.log1p(max(0, n_chars)) / 15),
    ]


class Featuriser:
    """Rows of (feature, value) for a batch of texts, as flat arrays with row starts."""

    def __init__(self):
        self.places: dict[bytes, int] = {}

    def _place(self, words: list[bytes]) -> list[int]:
        known = self.places
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            mask = (1 << WORD_BITS) - 1
            for w in words:
                if w not in known:
                    known[w] = zlib.crc32(w) & mask
            return [known[w] for w in words]

    def rows(self, texts: list[bytes], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of a row weigh ``WORD_MASS`` together, so that long and short texts compare."""
        features, values, starts, at = [], [], [], 0
        steps = np.arange(N_STRUCTURE) * STEPS + (1 << WORD_BITS)
        for text, chars in zip(texts, n_chars):
            words = text.split()
            shape = np.array(structure(text, words, chars))
            step = steps + np.minimum((shape * STEPS).astype(np.int64), STEPS - 1)
            features += [step, np.array(self._place(words), dtype=np.int64)]
            values += [np.ones(N_STRUCTURE), np.full(len(words), WORD_MASS / max(1, len(words)))]
            starts.append(at)
            at += N_STRUCTURE + len(words)
        return np.concatenate(features), np.concatenate(values), np.array(starts)


def machine(model: dict, features: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score before the link and the sum of the factors of each row."""
    weighted = model["factors"][features] * values[:, None]
    total = np.add.reduceat(weighted, starts)
    squares = np.add.reduceat(np.einsum("ij,ij->i", weighted, weighted), starts)
    linear = np.add.reduceat(model["linear"][features] * values, starts)
    return model["bias"] + linear + 0.5 * ((total * total).sum(axis=1) - squares), total


def fit(texts: list[bytes], n_chars: list, labels: np.ndarray, seed: int = 1) -> dict:
    """Adaptive gradient steps on the logistic loss, over shuffled small batches."""
    rng = np.random.default_rng(seed)
    model = {
        "bias": 0.0,
        "linear": np.zeros(SIZE),
        "factors": rng.normal(0, 0.02, (SIZE, RANK)),
    }
    maker = Featuriser()
    rows = []
    for text, chars in zip(texts, n_chars):
        f, v, _ = maker.rows([text], [chars])
        unique, where = np.unique(f, return_inverse=True)
        rows.append((unique, np.bincount(where, v)))
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            f = np.concatenate([rows[i][0] for i in pick])
            v = np.concatenate([rows[i][1] for i in pick])
            sizes = np.array([len(rows[i][0]) for i in pick])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            score, total = machine(model, f, v, starts)
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[pick]) / len(pick)
            row = np.repeat(np.arange(len(pick)), sizes)
            by_w = error[row] * v
            by_v = by_w[:, None] * (total[row] - model["factors"][f] * v[:, None])
            unique, where = np.unique(f, return_inverse=True)
            g_w = np.bincount(where, by_w) + DECAY * model["linear"][unique]
            g_v = np.stack([np.bincount(where, by_v[:, k]) for k in range(RANK)], axis=1)
            g_v += DECAY * model["factors"][unique]
            seen_w[unique] += g_w**2
            seen_v[unique] += g_v**2
            model["linear"][unique] -= RATE * g_w / np.sqrt(seen_w[unique])
            model["factors"][unique] -= RATE * 0.3 * g_v / np.sqrt(seen_v[unique])
            seen_b += error.sum() ** 2
            model["bias"] -= RATE * error.sum() / math.sqrt(seen_b)
    return model


def _pack(model: dict) -> bytes:
    return np.concatenate(([model["bias"]], model["linear"], model["factors"].ravel())).astype("<f4").tobytes()


def _unpack(packed: bytes) -> dict:
    flat = np.frombuffer(packed, dtype="<f4").astype(np.float64)
    return {"bias": flat[0], "linear": flat[1 : 1 + SIZE], "factors": np.ascontiguousarray(flat[1 + SIZE :].reshape(SIZE, RANK))}


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in b.to_pylist()]
    rows.sort(key=lambda r: (r["_text"], r["_label"], r["_chars"] is None, r["_chars"] or 0))
    labels = np.array([float(r["_label"]) for r in rows])
    if len(rows) and 0 < labels.sum() < len(labels):
        packed = _pack(fit([r["_text"] for r in rows], [r["_chars"] for r in rows], labels))
        yield pa.RecordBatch.from_pydict({"model": pa.array([packed], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, trainable: Column, max_rows: int = MAX_TRAIN) -> bytes | float:
    """The packed machine, or the constant score where nothing can be learned.

    ``trainable`` tells by ``doc_id`` which labels may be read. At most about ``max_rows`` of them, those
    with the smallest hashes, are looked up in the documents; the list of their ids is what is broadcast.
    """
    ship_package(docs.sparkSession)
    rated = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).filter(trainable)
    rated = rated.groupBy(F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
    found = rated.agg(F.count(F.lit(1)).alias("n"), F.avg("_label").alias("share")).first()
    if not found["n"]:
        return 1.0
    if found["share"] in (0.0, 1.0):
        return float(found["share"])
    portion = min(1.0, max_rows / found["n"])
    drawn = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30)) < int(portion * (1 << 30))
    sample = F.broadcast(rated.filter(drawn))
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("n_chars").cast("bigint").alias("_chars"), binary_text().alias("_text"))
    rows = texts.join(sample, "_id").select("_id", "_label", "_chars", "_text")
    fitted = rows.repartition(1).mapInArrow(_fit_task, "model binary").collect()
    return bytes(fitted[0]["model"]) if fitted else float(found["share"])


def _probability(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _scores(model: bytes | float):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine_ = _unpack(model.value) if not isinstance(model, float) else None
        maker = Featuriser()
        for batch in slices(batches, "_text", 1 << 20):
            if machine_ is None:
                score = np.full(batch.num_rows, model)
            else:
                raw, _ = machine(machine_, *maker.rows(batch.column("_text").to_pylist(), batch.column("_chars").to_pylist()))
                score = _probability(raw)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(score)], schema=schema)

    return run


def trainable() -> Column:
    """Labels of the other rows are held out."""
    return F.pmod(doc_crc(F.col("doc_id")), F.lit(3)) != 1


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_key, held_out, score and predicted of every row."""
    spark = docs.sparkSession
    model = train(docs, labels, trainable())
    if not isinstance(model, float):
        model = spark.sparkContext.broadcast(model)  # its size is fixed by WORD_BITS and RANK
    source = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit("")), "n_chars").alias("text_key"),
        F.col("n_chars").cast("bigint").alias("_chars"),
        binary_text().alias("_text"),
    )
    scored = source.mapInArrow(_scores(model), "doc_id bigint, text_key bigint, score double")
    return scored.select(
        "doc_id", "text_key", (~trainable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def _kept(model: bytes | float, text_at: int, chars_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine_ = _unpack(model.value) if not isinstance(model, float) else None
        maker = Featuriser()
        for batch in batches:
            if machine_ is None:
                keep = np.full(batch.num_rows, model >= 0.5)
            else:
                read = [batch.column(text_at).cast(pa.binary()).fill_null(b""), batch.column(chars_at).cast(pa.int64())]
                keep = np.empty(batch.num_rows, dtype=bool)
                done = 0
                for part in slices(iter([pa.RecordBatch.from_arrays(read, ["_text", "_chars"])]), "_text", 1 << 20):
                    raw, _ = machine(machine_, *maker.rows(part.column("_text").to_pylist(), part.column("_chars").to_pylist()))
                    keep[done : done + part.num_rows] = _probability(raw) >= 0.5
                    done += part.num_rows
            yield batch.filter(pa.array(keep))

    return run


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the machine does not reject, with all their columns.

    A row is judged where it is read: no join, and texts are not shuffled.
    """
    model = train(docs, labels, trainable())
    if not isinstance(model, float):
        model = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots cannot be passed
    kept = plain.mapInArrow(_kept(model, docs.columns.index("text"), docs.columns.index("n_chars")), plain.schema)
    return kept.toDF(*docs.columns)


def op2(spark: SparkSession, directory: str) -> DataFrame:
    return score(table(spark, directory, "documents"), table(spark, directory, "labels")).drop("text_key")


QUERIES = {"op2_quality_factorisation": op2}
