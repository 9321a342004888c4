"""Windows over series of any length, in blocks of rows.

A window without keys, or with a key that holds a third of all rows, sorts its rows in one task. That is
right for days and wrong for rows by the minute. Here rows are numbered in order first, in parallel. Every
``block_rows`` of them are a block, and a block is the largest group a task sorts, whatever the keys are:

* bounded frames (``by_blocks``): each block also gets copies of the rows within reach before and after it,
  so the operators for series give in a block what they give on the whole series;
* running totals (``running``): each block adds what the blocks before it sum up to.

Nulls in keys are one series, nulls in ``order`` come first. Rows that are equal in keys and order keep no
promised order among them, so ``order`` should end in something unique.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import store

BLOCK_ROWS = 100_000

POSITION, BLOCK, OWN = "_pos", "_block", "_own"

# Bits that ``monotonically_increasing_id`` keeps for the row within its partition.
_ROW_BITS = 33


def numbered(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), position: str = POSITION) -> tuple[DataFrame, int]:
    """The frame with every row's position from 0 in the order of keys and ``order``, and the number of rows.

    One shuffle into ranges. A row's place in its range is known after sorting the range; the sizes of the
    ranges, one number per shuffle partition, give the place of the range.
    """
    by = [*keys, *order]
    sorted_ranges = df.repartitionByRange(*by).sortWithinPartitions(*by)
    x = store(sorted_ranges.withColumn(position, F.monotonically_increasing_id()), "ranges")
    part = F.shiftright(position, _ROW_BITS)
    sizes = {r["part"]: r["rows"] for r in x.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    if not sizes:
        return x, 0
    ends = list(accumulate(sizes.get(i, 0) for i in range(max(sizes) + 1)))
    starts = F.array(*[F.lit(n).cast("long") for n in [0, *ends[:-1]]])
    row = F.col(position).bitwiseAND(F.lit((1 << _ROW_BITS) - 1).cast("long"))
    return x.withColumn(position, F.get(starts, part.cast("int")) + row), ends[-1]


def block_of(position: str | Column, block_rows: int) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.call_function("div", position, F.lit(block_rows).cast("long"))


def by_blocks(
    df: DataFrame,
    order: Sequence[str],
    build: Callable[[DataFrame, list[str]], DataFrame],
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``build(frame, keys)`` on blocks that reach ``before`` rows back and ``after`` rows ahead.

    ``build`` adds columns by windows over the keys it is given, ordered by ``POSITION``, whose frames stay
    within that reach; it may drop columns, but not ``OWN``. Rows are copied (before + after) / block_rows times.
    """
    x, rows = numbered(df, order, keys)
    last = max(rows - 1, 0) // block_rows
    pos = F.col(POSITION)
    blocks = F.sequence(
        block_of(F.greatest(pos - after, F.lit(0).cast("long")), block_rows),
        F.least(block_of(pos + before, block_rows), F.lit(last).cast("long")),
    )
    copies = x.withColumn(BLOCK, F.explode(blocks)).withColumn(OWN, F.col(BLOCK) == block_of(POSITION, block_rows))
    out = build(copies, [BLOCK, *keys])
    return out.filter(OWN).drop(OWN, BLOCK, POSITION)


# How two parts of a statistic become one; counts of parts are summed.
_MERGED = {"sum": "sum", "count": "sum", "min": "min", "max": "max"}
_FIRST = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _both(stat: str, a: Column, b: Column) -> Column:
    if stat in ("min", "max"):
        return (F.least if stat == "min" else F.greatest)(a, b)
    return F.coalesce(a + b, a, b)


def running(
    df: DataFrame,
    order: Sequence[str],
    columns: Mapping[str, tuple[str, str]],
    keys: Sequence[str] = (),
    strictly_before: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds ``columns``, name to (sum, count, min or max; value), over all rows of the series up to each row.

    A series reaches from one block into the next only across the edge between them, so two parts of a block
    matter to others: that of its first series and that of its last. These parts are a series of their own,
    shorter by the size of a block, and run the same way. With ``strictly_before`` the row itself is left out.
    """
    x, rows = numbered(df, order, keys)
    return running_at(x, rows, columns, keys, strictly_before, block_rows).select(*df.columns, *columns)


def running_at(
    x: DataFrame,
    rows: int,
    columns: Mapping[str, tuple[str, str]],
    keys: Sequence[str] = (),
    strictly_before: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``running`` for a frame that is numbered already; the position stays."""
    keys, own = list(keys), x.columns
    x = x.withColumn(BLOCK, block_of(POSITION, block_rows))
    frame = W.partitionBy(BLOCK, *keys).orderBy(POSITION).rowsBetween(W.unboundedPreceding, -1 if strictly_before else 0)
    inside = {name: _FIRST[stat](value).over(frame) for name, (stat, value) in columns.items()}
    if rows <= block_rows:
        return x.withColumns(inside).drop(BLOCK)

    parts = x.groupBy(BLOCK, *keys).agg(
        F.min(POSITION).alias("_first"),
        F.max(POSITION).alias("_last"),
        *[_FIRST[stat](value).alias(name) for name, (stat, value) in columns.items()],
    )
    start = F.col(BLOCK) * block_rows
    edges = parts.filter((F.col("_first") == start) | (F.col("_last") == start + (block_rows - 1)))
    merged = {f"_up_to_{name}": (_MERGED[stat], name) for name, (stat, _) in columns.items()}
    # Two parts a block at most: blocks of two rows or more make the parts fewer than the rows.
    earlier = running(edges.withColumnRenamed(BLOCK, "_at"), ["_at"], merged, keys, True, max(block_rows, 4))
    carried = earlier.filter(F.col("_first") == F.col("_at") * block_rows).select(
        F.col("_at").alias(BLOCK), *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *merged
    )
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    x = x.join(carried, BLOCK, "left").withColumns(inside)
    x = x.withColumns(
        {n: _both(stat, F.when(same, F.col(f"_up_to_{n}")), F.col(n)) for n, (stat, _) in columns.items()}
    )
    return x.select(*own, *columns)
