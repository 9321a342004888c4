"""Chat formatting by repairing roles at least cost.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the
last one by the assistant. Dynamic programming over this automaton chooses for every turn whether to
keep it, give it another role, merge it with the turn before, or put empty turns in front of it.

What a stretch of turns does is a small table: the least cost from each state before it to each state
after it. Tables of neighbouring stretches combine by the least sum, so a conversation of any length is
cut into segments of bounded size, the segments' tables are combined per partition and then per
conversation, and the chosen states are handed back down. No task holds a whole conversation.

Defined results: turns are ordered by ``turn``, then role and text; a null ``turn`` comes last. Roles are
compared without case and surrounding blanks; a null or unknown role has to be relabelled. Null text
is empty. Repeated rows are turns of their own (and are merged). Rows without ``conv_id`` are one
conversation. Equal costs go to the earlier state in the order start, system, user, assistant. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import table
from tallyloom.session import ship_package, store

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
MERGE, INSERT, RELABEL = 1, 2, 3
SEGMENT = 512
#: Characters after which a segment takes no further turn.
SEGMENT_CHARS = 4 << 20
_NEVER = 1 << 20
#: Turns from state to state along the automaton; all but the last are put in.
_STEPS = np.array([
    [_NEVER, 1, 1, 2],
    [_NEVER, _NEVER, 1, 2],
    [_NEVER, _NEVER, 2, 1],
    [_NEVER, _NEVER, 1, 2],
])
#: Empty turns needed to end legally.
_TO_END = (0, 2, 1, 0)


def turn_table(code: int) -> np.ndarray:
    """Least cost from the state before a turn to the state after it; the code is its own role, 0 if unknown."""
    fresh = np.where(_STEPS < _NEVER, (_STEPS - 1) * INSERT, _NEVER)
    cost = fresh.copy()
    for state in (SYSTEM, USER, ASSISTANT):
        cost[state, state] = min(cost[state, state], MERGE)
    cost[:, [s for s in range(4) if s != code]] += RELABEL
    return np.minimum(cost, _NEVER)


_TURNS = [turn_table(code) for code in range(4)]


def combine(tables: list[np.ndarray]) -> np.ndarray:
    out = tables[0]
    for following in tables[1:]:
        out = np.minimum((out[:, :, None] + following[None]).min(axis=1), _NEVER)
    return out


def best_states(tables: list[np.ndarray], entry: int, exit_: int) -> list[int]:
    """The state after each table on the cheapest way from entry to exit."""
    reach = [tables[0][entry]]
    for following in tables[1:]:
        reach.append((reach[-1][:, None] + following).min(axis=0))
    states = [exit_]
    for i in range(len(tables) - 1, 0, -1):
        states.append(int((reach[i - 1] + tables[i][:, states[-1]]).argmin()))
    return states[::-1]


@lru_cache(maxsize=100_000)
def segment_table(codes: bytes) -> np.ndarray:
    return combine([_TURNS[c] for c in codes])


def actions(codes: bytes, entry: int, exit_: int) -> list[tuple[str, int, int]]:
    """(action, new role, empty turns put in before) of each turn."""
    out, before = [], entry
    for code, state in zip(codes, best_states([_TURNS[c] for c in codes], entry, exit_)):
        merged = before == state and before != START and MERGE <= (_STEPS[before, state] - 1) * INSERT
        action = ("" if code == state else "relabel") + ("+merge" if merged else "")
        out.append((action.lstrip("+") or "keep", state, 0 if merged else int(_STEPS[before, state]) - 1))
        before = state
    return out


def empty_turns(before: int, count: int) -> str:
    """The turns put in after a state."""
    out, state = "", before
    for _ in range(count):
        state = ASSISTANT if state == USER else USER
        out += f"<|im_start|>{ROLES[state]}\n<|im_end|>\n"
    return out


_TURN = "struct<turn:bigint,role:string,text:string>"
_SEGMENT_DDL = f"conv_id bigint, part int, block bigint, codes binary, turns array<{_TURN}>"


def _code(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else 0


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns of a partition as rows of one conversation: SEGMENT turns at most, and few if they are long."""
    part, block, held, chars, conv = TaskContext.get().partitionId(), 0, [], 0, None
    turn = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def row() -> pa.RecordBatch:
        codes = bytes(_code(t["role"]) for t in held)
        columns = [pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([block], pa.int64())]
        columns += [pa.array([codes], pa.binary()), pa.array([held], pa.list_(turn))]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "block", "codes", "turns"])

    ready = []
    for batch in batches:
        for t in batch.to_pylist():
            here = t.pop("conv_id")
            if held and (here != conv or len(held) == SEGMENT or chars >= SEGMENT_CHARS):
                ready.append(row())
                block, held, chars = block + 1, [], 0
            conv = here
            held.append(t)
            chars += len(t["text"] or "") + len(t["role"] or "")
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
            ready = []
    if held:
        yield row()


_FLAT = pa.list_(pa.int32())


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column("codes").to_pylist()
        flat = pa.array([segment_table(c).ravel().tolist() for c in codes], _FLAT)
        sizes = pa.array([len(c) for c in codes], pa.int64())
        columns = [batch.column(c) for c in ("conv_id", "part", "block")]
        yield pa.RecordBatch.from_arrays([*columns, sizes, flat], names=["conv_id", "part", "block", "n", "table"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a conversation in a partition as one table."""
    for batch in batches:
        lists = batch.column("blocks").to_pylist()
        tables = [combine([np.array(b["table"]).reshape(4, 4) for b in blocks]).ravel().tolist() for blocks in lists]
        sizes = pa.array([sum(b["n"] for b in blocks) for blocks in lists], pa.int64())
        columns = [batch.column("conv_id"), batch.column("part"), sizes, pa.array(tables, _FLAT)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "n", "table"])


_WAY = ["entry", "exit", "offset", "last"]


def _handed(rows: list[dict], entry: int, exit_: int, offset: int, last: bool) -> Iterator[tuple]:
    """(entry, exit, offset, last) of consecutive tables, given those of the whole."""
    states = best_states([np.array(r["table"]).reshape(4, 4) for r in rows], entry, exit_)
    for i, (r, state) in enumerate(zip(rows, states)):
        yield entry, state, offset, last and i == len(rows) - 1
        entry, offset = state, offset + r["n"]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the tables of the partitions of a conversation: the states at their borders."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            whole = combine([np.array(p["table"]).reshape(4, 4) for p in r["parts"]])[START]
            exit_ = int((whole + INSERT * np.array(_TO_END)).argmin())
            for p, way in zip(r["parts"], _handed(r["parts"], START, exit_, 0, True)):
                out.append((r["conv_id"], p["part"], *way))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["conv_id", "part", *_WAY])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the states at the borders of a partition: those of its blocks."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            for b, way in zip(r["blocks"], _handed(r["blocks"], *(r[c] for c in _WAY))):
                out.append((r["conv_id"], r["part"], b["block"], *way))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
        if out:
            names = ["conv_id", "part", "block", *_WAY]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)


_RESULT = pa.schema([
    ("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("action", pa.string()),
    ("new_role", pa.string()), ("inserted", pa.int32()), ("inserted_at_end", pa.int32()), ("cost", pa.int32()), ("rendered", pa.string()),
])
_RESULT_DDL = (
    "conv_id bigint, position bigint, turn bigint, role string, action string, new_role string, inserted int, "
    "inserted_at_end int, cost int, rendered string"
)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns; their rendered parts, joined in order, are the rendered conversation."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            before = r["entry"]
            chosen = actions(r["codes"], r["entry"], r["exit"])
            for i, (t, (action, state, put_in)) in enumerate(zip(r["turns"], chosen)):
                ends = r["last"] and i == len(chosen) - 1
                text, merged = t["text"] or "", "merge" in action
                if merged:
                    piece = "\n" + text
                else:
                    close = "" if before == START else "<|im_end|>\n"
                    piece = close + empty_turns(before, put_in) + f"<|im_start|>{ROLES[state]}\n{text}"
                at_end = _TO_END[state] if ends else 0
                if ends:
                    piece += "<|im_end|>\n" + empty_turns(state, at_end)
                cost = MERGE * merged + RELABEL * ("relabel" in action) + INSERT * (put_in + at_end)
                place = r["offset"] + i
                out.append((r["conv_id"], place, t["turn"], t["role"], action, ROLES[state], put_in, at_end, cost, piece))
                before = state
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _RESULT)], schema=_RESULT)


def repair(turns: DataFrame) -> DataFrame:
    """One row per turn of (conv_id, turn, role, text): its place, the action taken and its rendered part."""
    ship_package(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.xxhash64("text"), F.col("text")]
    ranged = rows.repartitionByRange(*order[:4]).sortWithinPartitions(*order)
    segments = store(ranged.mapInArrow(_segments, _SEGMENT_DDL), "segments")
    tables = segments.select("conv_id", "part", "block", "codes").mapInArrow(
        _tables, "conv_id bigint, part int, block bigint, n bigint, table array<int>"
    )
    # A block per SEGMENT turns or SEGMENT_CHARS characters of a partition, and as many parts as there are partitions.
    in_part = tables.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("block", "n", "table"))).alias("blocks"))
    in_part = store(in_part, "chat-parts")
    parts = in_part.mapInArrow(_combined, "conv_id bigint, part int, n bigint, table array<int>")
    in_all = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "table"))).alias("parts"))
    way = "entry int, exit int, offset bigint, last boolean"
    ends = in_all.mapInArrow(_conversations, f"conv_id bigint, part int, {way}")
    ends = ends.withColumnRenamed("conv_id", "c").withColumnRenamed("part", "p")
    known = in_part.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    borders = known.select("conv_id", "part", "blocks", *_WAY).mapInArrow(
        _borders, f"conv_id bigint, part int, block bigint, {way}"
    )
    borders = borders.select(F.col("part").alias("p"), F.col("block").alias("b"), *_WAY)
    placed = segments.join(borders, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")))
    return placed.select("conv_id", "codes", "turns", *_WAY).mapInArrow(_render, _RESULT_DDL)


def render_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, cost and the whole rendered text, for conversations that fit one value."""
    pieces = F.sort_array(F.collect_list(F.struct("position", "rendered")))
    return repair(turns).groupBy("conv_id").agg(
        F.sum("cost").alias("cost"), F.array_join(F.transform(pieces, lambda p: p["rendered"]), "").alias("rendered")
    )


def op6(spark: SparkSession, directory: str) -> DataFrame:
    return repair(table(spark, directory, "conversations"))


QUERIES = {"op6_chat_repair": op6}
