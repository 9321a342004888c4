"""Runs of repeated words: exact maximal repetitions found by extensions in a recompressed text.

A run is a stretch with a smallest period q, at least max(``MIN_LENGTH``, 2q) words long, that no
neighbouring word continues. The words of a slice of texts are numbered and recompressed into one
run-length grammar (``recompression``), a word of its own kept between texts. Every run of period p covers
a place of the grid with step max(p, MIN_LENGTH - p) at which the word equals the one p further on; the
grid has n/p places for each p, n log n in all. The places that pass are extended exactly in both
directions by queries to the grammar; stretches long enough are runs, and of equal stretches the smallest
period is the right one, because the others are its multiples.

Work arrays are bounded by the slice (``SLICE_BYTES`` of text, or one longer text) and by ``PLACES``.

Defined results: null and empty text have no words, no run, and the digest of the empty string. Repeated
rows are searched each for themselves. A null id leaves the text as it is. An empty table gives no rows.
Only the id and the text column are read, so that other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import binary_text, slices, table
from tallyloom.llm.recompression import common_extension, grammar, mirror
from tallyloom.session import ship_package

#: The shortest run that counts, in words.
MIN_LENGTH = 12
#: Text that is recompressed together, and grid places that are tested at once.
SLICE_BYTES, PLACES = 1 << 20, 1 << 20


def _grid(sizes: np.ndarray, begins: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grids of all texts, some ``PLACES`` at a time."""
    periods = sizes // 2
    text = np.repeat(np.arange(len(sizes)), periods)
    p = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(p, least - p)
    counts = np.maximum(0, -(-(sizes[text] - p) // step))
    ends = np.cumsum(counts)
    low = 0
    while low < len(text):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + PLACES, "right")))
        n = counts[low:high]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(begins[text[low:high]], n) + place * np.repeat(step[low:high], n), np.repeat(p[low:high], n)
        low = high


def find_runs(texts: list[np.ndarray], least: int = MIN_LENGTH) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of sequences of numbers >= 0, in that order."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    fences = np.append(0, begins + sizes)  # a word of its own before each text and after the last
    joined = np.empty(int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    joined[fences] = -1 - np.arange(len(fences))
    if len(texts):
        inside = np.ones(len(joined), dtype=bool)
        inside[fences] = False
        joined[inside] = np.concatenate(texts)
    found = [np.empty((0, 3), dtype=np.int64)]
    forward = backward = None
    for place, p in _grid(sizes, begins, least):
        equal = joined[place] == joined[place + p]
        place, p = place[equal], p[equal]
        if not len(place):
            continue
        if forward is None:
            forward = grammar(joined)
            backward = mirror(forward)
        after = common_extension(forward, place, place + p)
        last = len(joined) - 1
        before = common_extension(backward, last - (place - 1), last - (place + p - 1))
        length = before + after + p
        long = length >= np.maximum(least, 2 * p)
        found.append(np.stack([(place - before)[long], length[long], p[long]], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    text = np.searchsorted(begins, rows[:, 0], "right") - 1
    rows = np.column_stack([text, rows[:, 0] - begins[text], rows[:, 1], rows[:, 2]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def repeat_tail(n: int, doc_id: int) -> np.ndarray | None:
    """Numbers of the original words after the tail of one text in ten is made periodic; None: as it is."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def without_repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run contains beyond its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.binary())])
FOUND = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"


def _search(least: int, planted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE_BYTES):
            ids = batch.column("doc_id").to_pylist()
            words = [t.split() for t in batch.column("_text").to_pylist()]
            orders = [repeat_tail(len(w), i) if planted and i is not None else None for w, i in zip(words, ids)]
            words = [w if o is None else [w[k] for k in o.tolist()] for w, o in zip(words, orders)]
            names: dict[bytes, int] = {}
            numbered = [np.array([names.setdefault(x, len(names)) for x in w], dtype=np.int64) for w in words]
            rows = find_runs(numbered, least)
            cuts = np.searchsorted(rows[:, 0], np.arange(len(ids) + 1))
            runs, kept = [], []
            for k, w in enumerate(words):
                own = rows[cuts[k] : cuts[k + 1], 1:]
                runs.append([dict(zip(("start", "length", "period"), r)) for r in own.tolist()])
                if len(own):
                    stays = without_repeats(len(w), own)
                    w = [x for x, s in zip(w, stays.tolist()) if s]
                kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(kept, pa.binary())], schema=_FOUND
            )

    return run


def periodic_runs(docs: DataFrame, least: int = MIN_LENGTH, planted: bool = False) -> DataFrame:
    """doc_id, runs and the text without its repetitions (``collapsed``), one row for every row of ``docs``.

    ``planted`` makes the tail of one text in ten periodic first, as a check of the search.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), binary_text().alias("_text"))
    return source.mapInArrow(_search(least, planted), FOUND)


def op11(spark: SparkSession, directory: str) -> DataFrame:
    return digest(periodic_runs(table(spark, directory, "documents"), planted=True))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of what ``periodic_runs`` found."""
    # The longest; of those the first, then the one with the smallest period: max of (length, -start, -period).
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.withColumn("_top", top).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("_top.s")).alias("start"),
        F.col("_top.n").alias("length"),
        (-F.col("_top.p")).alias("period"),
        F.expr("1000 * _top.n div -_top.p").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11}
