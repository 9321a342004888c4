"""Secrets in whole texts: known forms by expression, unknown ones by how badly they tokenize.

A vocabulary learned from text spends few tokens on text and many on random strings. So a long run of
letters and digits that gets few characters per token is taken for a secret, unless it is a known
form of something public: a digest in hexadecimal, a UUID, or an identifier whose parts are words and
numbers. The run is tested as a whole and by its parts between joints: parts that are no words, numbers,
digests or UUIDs count together, so a readable path or name before a random string does not hide it.
A part is a word by its own characters per token, not by its form; letters of one case need fewer of them
(``FEWEST_IN_ONE_CASE``) than a part with digits or capitals inside, because rare words tokenize badly too.
A run is told whole.

Defined results: null text counts as empty and has no spans. Offsets count code points. Rows are kept
as they come, repeated ones too. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import binary_text, slices, table
from tallyloom.session import ship_package

# The known forms.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_EITHER = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    for word in ("password", "passwd", "secret", "token")
) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = re.compile(rf"({_EITHER})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

#: A run shorter than this is left alone; a longer one needs more characters per token to pass.
MIN_RUN, FEWEST_CHARS_PER_TOKEN = 16, 2.0
#: The same for a part of letters in one case, a first capital aside.
FEWEST_IN_ONE_CASE = 1.8
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_INNER_UUID = re.compile(rf"(?<![A-Za-z0-9])(?:{_UUID.pattern})(?![A-Za-z0-9])")
_SHORT = re.compile(r"[A-Za-z]{1,3}[0-9]{0,4}")
_JOINTS = re.compile(r"[+/_=-]")
_NAME_PART = re.compile(r"[A-Za-z]*[0-9]{0,4}|[0-9]+")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def vocabulary(path: str):
    """One per worker process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known_forms(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and not overlapping within a kind."""
    spans = []
    lowered = text.lower()
    if any(word in lowered for word in KEYWORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    # A run of hexadecimal digits is matched whole from its first one, so the length can be asked for.
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def is_public_form(run: str) -> bool:
    """Digests, UUIDs, and names made of words and numbers."""
    if len(run) in _DIGEST_LENGTHS and _ALL_HEX.fullmatch(run):
        return True
    return bool(_UUID.fullmatch(run)) or all(map(_NAME_PART.fullmatch, _JOINTS.split(run)))


def is_readable(part: str, encoding, fewest: float = FEWEST_CHARS_PER_TOKEN) -> bool:
    """Words, numbers and digests; up to three letters with up to four digits (``v2``) are too short to tell."""
    if not part or part.isdigit() or len(part) in _DIGEST_LENGTHS and _ALL_HEX.fullmatch(part) or _SHORT.fullmatch(part):
        return True
    if part.isalpha() and (part.isupper() or part[1:].islower()):
        fewest = min(fewest, FEWEST_IN_ONE_CASE)
    return len(part) > fewest * len(encoding.encode_ordinary(part))


def has_random_parts(run: str, encoding, fewest: float = FEWEST_CHARS_PER_TOKEN) -> bool:
    """Whether the parts that are not readable make up a run of their own."""
    parts = _JOINTS.split(_INNER_UUID.sub("-", run))
    if sum(map(len, parts)) < MIN_RUN:
        return False
    return sum(len(p) for p in parts if not is_readable(p, encoding, fewest)) >= MIN_RUN


def _outside(start: int, end: int, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """What sorted spans leave of a stretch."""
    for a, b, _ in spans:
        if b > start and a < end:
            if a > start:
                yield start, a
            start = b
    if start < end:
        yield start, end


def random_runs(
    text: str, encoding, fewest: float = FEWEST_CHARS_PER_TOKEN, known: list[tuple[int, int, str]] = ()
) -> list[tuple[int, int, str]]:
    """Runs of letters and digits with few characters per token; the spans in ``known`` are cut out of them."""
    if max(map(len, text.split()), default=0) < MIN_RUN:
        return []
    found = []
    known = sorted(known)
    for a, b in (piece for m in _RUN.finditer(text) for piece in _outside(m.start(), m.end(), known)):
        run = text[a:b]
        if len(run) < MIN_RUN:
            continue
        mixed = any(c.isdigit() for c in run) and any(c.isalpha() for c in run)
        whole = mixed and not is_public_form(run) and len(run) <= fewest * len(encoding.encode_ordinary(run))
        if whole or has_random_parts(run, encoding, fewest):
            found.append((a, b, "random"))
    return found


def spans_of(text: str, encoding, fewest: float = FEWEST_CHARS_PER_TOKEN) -> list[tuple[int, int, str]]:
    """All spans by start, then kind; what lies in a known form is not told again, what lies beside it is."""
    base = known_forms(text)
    return sorted(base + random_runs(text, encoding, fewest, base), key=lambda s: (s[0], KINDS.index(s[2])))


_SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def _scan(path: str, fewest: float):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    schema = pa.schema([("doc_id", pa.int64()), ("spans", spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(path)
        for batch in slices(batches, "_text"):
            found = [
                [dict(zip(("start", "end", "kind"), s)) for s in spans_of(t.decode("utf-8", "replace"), encoding, fewest)]
                for t in batch.column("_text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, spans)], schema=schema)

    return run


def find_secrets(docs: DataFrame, path: str | None = None, fewest: float = FEWEST_CHARS_PER_TOKEN) -> DataFrame:
    """doc_id and spans (start, end, kind) of every row, in order."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), binary_text().alias("_text"))
    return source.mapInArrow(_scan(path or default_ranks(), fewest), f"doc_id bigint, spans {_SPANS}")


def op7(spark: SparkSession, directory: str) -> DataFrame:
    found = find_secrets(table(spark, directory, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = told(F.filter("spans", lambda s: s["kind"] != "random"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(base, 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), count("random"),
    )


QUERIES = {"op7_secret_scan": op7}
