"""Exact duplicates by content-defined chunk recipes.

A text is cut where a rolling hash of its own bytes says so, and becomes a recipe: the ordered list
of the identifiers of its chunks. Equal texts have equal recipes. Chunks travel once, to verify that
one identifier stands for one content; documents are then compared by recipes, which hold 16 bytes
for about a thousand bytes of text.

Defined results: null text counts as empty, an empty text has an empty recipe and is equal to other
empty ones. Rows that repeat both id and text are returned as often as they occur, and one of them
stays. A null id sorts last, so it stays only where no row of the group has an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACE, binary_text, slices, table
from tallyloom.session import ship_package, store

WINDOW = 32
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 256, 10, 8192
_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)
_BLANK = b" \t\n\r\x0b\x0c"


def normalise(text: bytes) -> bytes:
    """Each run of white space as one space."""
    words = b" ".join(text.split())
    if not text or not words:
        return b" " if text else b""
    return b" " * (text[0] in _BLANK) + words + b" " * (text[-1] in _BLANK)


def cut_points(texts: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each text.

    The hash at a byte covers the 32 bytes up to it and nothing else, so a passage is cut alike
    wherever it stands. Doubling the window adds up all shifts in five steps.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    rolling = _GEAR[data]
    span = 1
    while span < WINDOW and span < len(rolling):
        longer = rolling.copy()
        longer[span:] += rolling[:-span] << np.uint32(span)
        rolling, span = longer, span * 2
    marks = np.flatnonzero(rolling >> np.uint32(32 - MEAN_BITS) == 0) + 1
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    first = np.searchsorted(marks, bounds)
    out = []
    for i, text in enumerate(texts):
        cuts, last, size = [], 0, len(text)
        for mark in (marks[first[i] : first[i + 1]] - bounds[i]).tolist():
            while mark - last > MAX_CHUNK:
                last += MAX_CHUNK
                cuts.append(last)
            if mark - last >= MIN_CHUNK and mark < size:
                last = mark
                cuts.append(last)
        while size - last > MAX_CHUNK:
            last += MAX_CHUNK
            cuts.append(last)
        if last < size:
            cuts.append(size)
        out.append(cuts)
    return out


def _cut(texts: list[bytes], id_bytes: int) -> list[list[tuple[bytes, bytes]]]:
    """(identifier, content) of the chunks of each text."""
    out = []
    for text, cuts in zip(texts, cut_points(texts)):
        parts = [text[a:b] for a, b in zip([0, *cuts], cuts)]
        out.append([(xxhash.xxh3_128_digest(p)[:id_bytes], p) for p in parts])
    return out


def _recipes(id_bytes: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = [normalise(t) for t in batch.column("_text").to_pylist()]
            recipes = [[i for i, _ in chunks] for chunks in _cut(texts, id_bytes)]
            shas = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(shas, pa.string()), pa.array(recipes, pa.list_(pa.binary()))],
                schema=schema,
            )

    return run


def _contents(id_bytes: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_sha256", pa.string()), ("pos", pa.int32()), ("id", pa.binary()), ("content", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            ids = batch.column("doc_id").to_pylist()
            texts = [normalise(t) for t in batch.column("_text").to_pylist()]
            shas = [hashlib.sha256(t).hexdigest() for t in texts]
            cut = _cut(texts, id_bytes)
            rows = [(d, s, k, i, c) for d, s, chunks in zip(ids, shas, cut) for k, (i, c) in enumerate(chunks)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


def recipes(docs: DataFrame, id_bytes: int = 16) -> DataFrame:
    """doc_id, text_sha256 and recipe of every row, with verified identifiers.

    ``id_bytes`` of a 128-bit hash name a chunk. Contents are told apart by their bytes: where two of
    them share a name, a number per content is added to it wherever that chunk occurs.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), binary_text().alias("_text"))
    kept = store(
        source.mapInArrow(_recipes(id_bytes), "doc_id bigint, text_sha256 string, recipe array<binary>"), "recipes"
    )
    chunks = source.mapInArrow(
        _contents(id_bytes), "doc_id bigint, text_sha256 string, pos int, id binary, content binary"
    )
    names = chunks.select("id", "content").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("contents"))
    shared = store(names.filter("contents > 1").select("id"), "shared-names")
    if shared.isEmpty():
        return kept
    clash = chunks.join(shared, "id", "left_semi")
    number = F.row_number().over(W.partitionBy("id").orderBy("content"))
    numbered = clash.select("id", "content").distinct().withColumn("number", number)
    places = clash.join(numbered, ["id", "content"]).select("doc_id", "text_sha256", "pos", "number").distinct()
    added = places.groupBy("doc_id", "text_sha256").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", F.col("number").cast("string").cast("binary")))).alias("added")
    )
    same = kept["doc_id"].eqNullSafe(added["doc_id"]) & (kept["text_sha256"] == added["text_sha256"])
    exact = F.transform("recipe", lambda i, k: F.concat(i, F.coalesce(F.col("added")[k], F.lit(b""))))
    renamed = F.when(F.col("added").isNull(), F.col("recipe")).otherwise(exact)
    return kept.join(added, same, "left").select(kept["doc_id"], kept["text_sha256"], renamed.alias("recipe"))


def exact_groups(docs: DataFrame, id_bytes: int = 16) -> DataFrame:
    """One row per document: keep_id, group_size, kept and text_sha256.

    Rows of a group meet its one summary row in a join, so a group of any size is a partial
    aggregate first and can be split on the other side of the join.
    """
    rows = recipes(docs, id_bytes).groupBy("doc_id", "text_sha256", "recipe").agg(F.count(F.lit(1)).alias("_rows"))
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.sum("_rows").alias("group_size"))
    # Written, so that the join below starts from plain shuffles, which adaptive execution can split.
    groups = store(groups, "recipe-groups")
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows"))).alias("_copy")
    return (
        rows.join(groups, "recipe")
        .select("doc_id", "keep_id", "group_size", "text_sha256", each)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1))
        .drop("_copy")
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A group keeps the row with its smallest id. Of rows that repeat both id and text, the one whose
    other columns sort first stays. Only rows to be dropped are looked up, by id and digest, so texts
    stay where they are unless that list outgrows a broadcast.
    """
    groups = store(exact_groups(docs), "exact-groups")
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "), 256)
    kept_keys = groups.filter("kept").select(F.col("doc_id").alias("__dup_id"), F.col("text_sha256").alias("__dup_sha"))
    lost = groups.filter("not kept").select(F.col("doc_id").alias("__dup_id"), F.col("text_sha256").alias("__dup_sha")).distinct()
    match = docs["doc_id"].eqNullSafe(F.col("__dup_id")) & (sha == F.col("__dup_sha"))
    single = docs.join(lost, match, "left_anti")
    # Keys that are both kept and dropped belong to repeated rows: one of them comes back.
    repeated = lost.join(kept_keys, ["__dup_id", "__dup_sha"], "left_semi").unionByName(
        lost.filter("__dup_id is null").join(kept_keys.filter("__dup_id is null"), "__dup_sha", "left_semi")
    )
    if repeated.isEmpty():
        return single
    names = [F.col(f"`{c}`") for c in docs.columns]
    order = [c.asc_nulls_last() for c in names]
    first = F.row_number().over(W.partitionBy("__dup_id", "__dup_sha").orderBy(*order))
    again = docs.join(repeated, match).withColumn("__dup_first", first).filter("__dup_first = 1")
    return single.unionByName(again.select(*names))


def op1(spark: SparkSession, directory: str) -> DataFrame:
    return exact_groups(table(spark, directory, "documents"))


QUERIES = {"op1_exact_dedup": op1}
SQL = {
    "op1_exact_dedup": r"""
        with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
        n as (select doc_id, sha256(t) as text_sha256, t from d)
        select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = min(doc_id) over (partition by t) as kept, text_sha256
        from n"""
}
