"""Small awkward tables for the corpus operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # Names that operators use inside.
    "_id string, _label int, `a.b` int, fp string, size int, rank int, score string, `group` int, node string, n int, hash string, target int"
)
EXTRA = ("i", 1, 2, "x", 1, 2, "s", 3, "nd", 4, "h", 5)
SYLLABLES = "the ing an er or re st th ou ea in on ti ha nd es is".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(words))


def rows() -> list[tuple]:
    rng = random.Random(5)
    out = []
    for i in range(60):
        out.append((i, prose(rng, rng.randint(5, 120)) + ".", "en", f"src{i % 4}", None))
    base = prose(rng, 200)
    out += [(100 + k, base, "en", "src0", 10) for k in range(20)]  # a hot group of copies
    out += [(130 + k, base.replace(" ", " \t" if k % 2 else "\n"), "en", "src0", 10) for k in range(4)]
    near = base.split(" ")
    out += [(140 + k, " ".join(near[: 50 + k] + ["changed"] + near[51 + k :]), "en", None, 10) for k in range(3)]
    out += [
        (200, None, None, None, None),
        (201, "", "en", "src1", 0),
        (202, " \n ", None, "src1", 3),
        (203, "!!! 123", "de", "src2", 7),
        (204, prose(rng, 30_000), "en", "src2", None),  # very long
        (205, "Ünïcode ß 日本語 text 😀 end", "de", "src3", 20),
        (206, " leading and trailing ", "en", "src3", 22),
        (206, " leading and trailing ", "en", "src3", 22),  # a repeated row
        (207, "same id", "en", "src3", 7),
        (207, "another text under the same id", "en", "src3", 30),
        (None, "no id at all", "en", "src3", 12),
        (None, "no id at all", "en", "src3", 12),
    ]
    return [(*r, *EXTRA) for r in out]


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
