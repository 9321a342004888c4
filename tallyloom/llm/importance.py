"""Importance resampling towards a target: word buckets counted and scored through an Aho-Corasick dictionary.

Texts are cut into slices of bounded size. The distinct words of a slice, each bounded by a delimiter on
both sides, form a dictionary whose payload is a word's number, which leads to its CRC and length. One scan
of the automaton over the slice emits the payload of every word in order. The CRC of a run of words joined
by spaces is composed from the payloads of its neighbours (a CRC of a longer string is a linear map of the
CRC of its front, chosen by the length that follows), so runs of any number of words cost no other look at
the text. CRC modulo ``BUCKETS`` is the bucket of a feature.

First pass: every task adds up the buckets of its texts and hands on one row per bucket, for the documents
and for the target texts. The gains of the buckets, a table of fixed size, then travel to the second pass,
which scans again and gives each document its floored mean gain. The score adds noise that the id decides
(Gumbel, so that the highest scores are a draw without replacement by weight). Ranks need no global sort:
scores are whole numbers in a narrow range, so a histogram of scores shifts ranks that are found within
each score.

Defined results: null and empty text have no feature and weight 0. A null id takes part with the digest of
``2024:``. Repeated rows are drawn each for themselves; rows with one id and one score may swap ranks. With
no target texts, or no documents, counts are 0 and the formula holds. An empty table gives no rows. Only the
id and the text column are read, so that other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import binary_text, slices, table
from tallyloom.session import ship_package, store

BUCKETS = 10_000
#: The longest run of words that is a feature.
MAX_WORDS = 1
#: Documents with fewer words are never drawn; of the others so many in a hundred are.
MIN_WORDS, PERCENT = 20, 10
SEED = "2024:"
SLICE_BYTES = 2 << 20

# Every byte that separates words becomes a space, capital letters of ASCII become small ones.
_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_PLAIN = bytes(b if b in _WORD_BYTES else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


# Composition of CRCs ---------------------------------------------------------------------------

# Fixed value: the reversed polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


@cache
def _after_zeros(log_bytes: int) -> np.ndarray:
    """What each bit of a CRC becomes when 2**log_bytes zero bytes follow."""
    if log_bytes == 0:
        bits = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
        for _ in range(8):
            bits = np.where(bits & 1, (bits >> 1) ^ np.uint32(_POLYNOMIAL), bits >> 1).astype(np.uint32)
        return bits
    half = _after_zeros(log_bytes - 1)
    return _apply(half, half)


def _apply(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros(len(crc), dtype=np.uint32)
    for bit in range(32):
        out ^= np.where(crc >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def combine(front: np.ndarray, back: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC of two strings joined, from the CRC of each and the bytes of the second."""
    out = front.astype(np.uint32)
    for k in range(int(size.max(initial=0)).bit_length()):
        longer = np.flatnonzero(size >> k & 1)
        out[longer] = _apply(_after_zeros(k), out[longer])
    return out ^ back.astype(np.uint32)


# Scans -----------------------------------------------------------------------------------------


class Dictionary:
    """The distinct words of some text, each between delimiters, with CRC and length as payload."""

    def __init__(self, words: set[bytes]):
        self.words = sorted(words)
        self.crc = np.array([zlib.crc32(w) for w in self.words], dtype=np.uint32)
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, word in enumerate(self.words):
            self.automaton.add_word(f" {word.decode('latin-1')} ", number)
        if self.words:
            self.automaton.make_automaton()

    def scan(self, plain: bytes) -> np.ndarray:
        """Numbers of the words of a delimited text, in order."""
        if not self.words:
            return np.empty(0, dtype=np.int64)
        return np.fromiter((n for _, n in self.automaton.iter(plain.decode("latin-1"))), dtype=np.int64)


def features(texts: list[bytes], max_words: int = MAX_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, CRC) of the features of some texts, for runs of 1 word, of 2 words and so on."""
    plain = [t.translate(_PLAIN).split() for t in texts]
    known = Dictionary(set().union(*plain)) if plain else Dictionary(set())
    counts = np.array([len(w) for w in plain], dtype=np.int64)
    found = known.scan(b" " + b" ".join(b" ".join(w) for w in plain if w) + b" ")
    text = np.repeat(np.arange(len(texts)), counts)
    crc, size = known.crc[found], known.size[found]
    run = crc
    space = np.full(1, zlib.crc32(b" "), dtype=np.uint32)
    for n in range(1, max_words + 1):
        if n > 1:  # the run so far, a space, and the word that follows it within the same text
            together = text[n - 1 :] == text[: len(text) - n + 1] if len(text) >= n else np.empty(0, dtype=bool)
            spaced = combine(run[: len(together)], np.broadcast_to(space, len(together)), np.ones(len(together), dtype=np.int64))
            run = combine(spaced, crc[n - 1 :], size[n - 1 :])
            yield text[: len(together)][together], run[together]
        else:
            yield text, run


def _count(buckets: int, max_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches, "_text", SLICE_BYTES):
            for _, crc in features(batch.column("_text").to_pylist(), max_words):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> DataFrame:
    """(bucket, n) of all features of the column ``text``; buckets without a feature are left out."""
    ship_package(texts.sparkSession)
    partial = texts.select(binary_text().alias("_text")).mapInArrow(_count(buckets, max_words), "bucket bigint, n bigint")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> np.ndarray:
    """Floored thousandths of the log ratio of each bucket's share in the target to its share in the documents."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, texts in ((s, docs), (t, target)):
        for row in bucket_counts(texts, buckets, max_words).collect():  # at most one row per bucket
            counts[row["bucket"]] = row["n"]
    ratio = (t + 1.0) * (s.sum() + buckets) / ((s + 1.0) * (t.sum() + buckets))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


_WEIGHED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
WEIGHED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"


def _weigh(shared, max_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in slices(batches, "_text", SLICE_BYTES):
            rows = batch.num_rows
            number, total, words = (np.zeros(rows, dtype=np.int64) for _ in range(3))
            for k, (text, crc) in enumerate(features(batch.column("_text").to_pylist(), max_words)):
                n = np.bincount(text, minlength=rows)
                words = n if k == 0 else words
                number += n
                np.add.at(total, text, gain[crc % np.uint32(len(gain))])
            weight = np.floor_divide(total, np.maximum(number, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words), pa.array(number), pa.array(weight)], schema=_WEIGHED
            )

    return run


def weigh(docs: DataFrame, gain: np.ndarray, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain of the features) of every row."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), binary_text().alias("_text"))
    return source.mapInArrow(_weigh(shared, max_words), WEIGHED)


def noise() -> F.Column:
    """Floored thousandths of a Gumbel variable that the id decides."""
    named = F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """Every document with weight, score and, where drawn, its rank from 1 by score."""
    weighed = weigh(docs, gains(docs, target, buckets, max_words), max_words)
    scored = store(weighed.withColumn("score", F.col("weight") + noise()), "scored")
    usable = scored.filter(F.col("n_words") >= min_words)
    # One row per score: the whole numbers between the least and the greatest.
    histogram = usable.groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    higher = W.partitionBy(F.lit(0)).orderBy(F.col("score").desc())
    drawn = F.floor(F.sum("_n").over(W.partitionBy(F.lit(0))) * F.lit(percent) / F.lit(100))
    before = F.coalesce(F.sum("_n").over(higher.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    limits = histogram.select("score", before.alias("_before"), drawn.cast("bigint").alias("_drawn")).filter("_before < _drawn")
    within = F.row_number().over(W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    ranked = usable.join(limits, "score").withColumn("rank", F.col("_before") + within)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= F.col("_drawn"), F.col("rank")))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = usable.join(limits, "score", "left_anti").unionByName(scored.filter(F.col("n_words") < min_words))
    return ranked.select(*columns, "rank").unionByName(rest.select(*columns, F.lit(None).cast("bigint").alias("rank")))


def op13(spark: SparkSession, directory: str) -> DataFrame:
    found = resample(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_importance_resampling": op13}

#: CRC-32 in SQL: a table of 256 remainders, each from eight shifts, then one look-up a byte.
_SQL = rf"""
with remainders as (
    select list(list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c // 2, {_POLYNOMIAL}::bigint) else c // 2 end, b) order by b) as r
    from range(256) as _(b)),
doc_words as (
    select doc_id, row_number() over () as row_no, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
bench_words as (
    select unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
each_word as (select row_no, unnest(words) as word from doc_words),
vocabulary as (select word, hex(encode(word)) as bytes from (select word from each_word union select word from bench_words)),
buckets as (
    select word, xor(list_reduce(
        [('0x' || substr(bytes, 2 * i + 1, 2))::bigint for i in range(length(bytes) // 2)],
        lambda c, b: xor(c // 256, r[1 + xor(c % 256, b)]), 4294967295::bigint), 4294967295::bigint) % {BUCKETS} as bucket
    from vocabulary, remainders),
s as (select bucket, count(*) as n from each_word join buckets using (word) group by bucket),
t as (select bucket, count(*) as n from bench_words join buckets using (word) group by bucket),
gain as (
    select b.bucket, cast(floor(1000 * ln(((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + {BUCKETS})::double)
        / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + {BUCKETS})::double))) as bigint) as gain
    from (select range as bucket from range({BUCKETS})) b left join s using (bucket) left join t using (bucket)),
weights as (
    select row_no, count(*) as n, cast(floor(sum(gain)::double / count(*)) as bigint) as weight
    from each_word join buckets using (word) join gain using (bucket) group by row_no),
scored as (
    select doc_id, len(words) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}' || coalesce(doc_id::varchar, '')), 1, 8))::bigint
            + 0.5::double) / 4294967296::double))) as bigint) as score
    from doc_words left join weights using (row_no)),
ranked as (
    select *, row_number() over (partition by n_features >= {MIN_WORDS} order by score desc, doc_id) as place,
        floor(count(*) over (partition by n_features >= {MIN_WORDS}) * {PERCENT} / 100) as drawn
    from scored)
select doc_id, cast(n_features as bigint) as n_features, weight, score,
    case when n_features >= {MIN_WORDS} and place <= drawn then place end as rank
from ranked
"""

SQL = {"op13_importance_resampling": _SQL}
