"""Shared by the query modules: rounding for comparison, and the daily series."""

from __future__ import annotations

import threading
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.series import densify
from tallyloom.session import store
from tallyloom.sources.tables import SharedStarTables, StarTables


def rounded(df: DataFrame, digits: dict[str, int], nudge: float = 0.0) -> DataFrame:
    """Round the named columns, so that two engines summing in another order agree.

    ``nudge`` is added first where values tend to lie exactly between two rounded ones.
    """
    return df.withColumns({c: F.round(F.col(c) + F.lit(nudge), n) for c, n in digits.items()})


_LOCKS: dict[tuple, threading.RLock] = {}
_LOCKS_GUARD = threading.Lock()


@contextmanager
def only_one(*names):
    """Hold the locks of all names: what several queries of a run need is computed by one of them."""
    with ExitStack() as stack:
        for name in sorted(names, key=repr):
            with _LOCKS_GUARD:
                lock = _LOCKS.setdefault(name, threading.RLock())
            stack.enter_context(lock)
        yield


def once(t: StarTables, name: str, build) -> DataFrame:
    """A frame that several steps read, written to the shared folder the first time."""
    with only_one((id(t), name)):
        kept = t.__dict__.setdefault("_stored", {})
        if name not in kept:
            kept[name] = store(build(), name)
        return kept[name]


def shared(t, name: str, build) -> DataFrame:
    """``once`` in a run of many queries; a query on its own keeps its lazy plan."""
    return once(t, name, build) if isinstance(t, SharedStarTables) else build()


def daily_sales(t: StarTables) -> DataFrame:
    """The one total series, a row for every calendar day.

    The lines are read once, for the roll-up to days; everything after that reads the days.
    """
    return densify(once(t, "daily", t.sales), [], ["revenue", "cogs"])


def segment_days(t: StarTables) -> DataFrame:
    """Daily sales per product segment, days with sales only."""
    return once(t, "panel", lambda: t.sales(keys=("segment",)).withColumnRenamed("segment", "series"))


def panel_sales(t: StarTables) -> DataFrame:
    """One series per product segment, each with a row for every calendar day."""
    return densify(segment_days(t), ["series"], ["revenue", "cogs"])
