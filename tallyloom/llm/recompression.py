"""Longest common extensions by recompression: a run-length grammar of a sequence, built in rounds.

Each round compresses maximal blocks of one symbol, then pairs of neighbours whose first symbol lies in
one half of the alphabet and whose second lies in the other. Phrases that agree get one name, so a level
is a shorter sequence over a new alphabet, and equal stretches of the text are cut in the same way but for
one phrase at each end. A common extension is therefore read off by climbing until the names differ and
coming down again: a constant number of steps a level, for any number of queries at once.
"""

from __future__ import annotations

import numpy as np


def _names(keys: np.ndarray) -> np.ndarray:
    """Dense numbers for equal keys."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _half(symbols: np.ndarray, seed: int) -> np.ndarray:
    """A bit per symbol, the same wherever the symbol stands."""
    mixed = (symbols.astype(np.uint64) + np.uint64(seed * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(40)) & np.uint64(1) == 1


class Level:
    """One sequence of the grammar and how the next one cuts it.

    ``first`` holds the place where each phrase begins, and the length at its end; ``owner`` the phrase of
    each place. The last level has neither.
    """

    __slots__ = ("symbols", "first", "owner")

    def __init__(self, symbols: np.ndarray, starts: np.ndarray | None = None):
        self.symbols = symbols
        self.first = self.owner = None
        if starts is not None:
            self.first = np.append(np.flatnonzero(starts), len(symbols))
            self.owner = np.cumsum(starts) - 1

    def mirrored(self) -> Level:
        back = Level(self.symbols[::-1])
        if self.first is not None:
            back.first = len(self.symbols) - self.first[::-1]
            back.owner = len(self.first) - 2 - self.owner[::-1]
        return back


def grammar(sequence: np.ndarray) -> list[Level]:
    """All levels, from the sequence itself to a single symbol."""
    levels, symbols, seed = [], _names(sequence), 0
    while len(symbols) > 1:
        starts = np.ones(len(symbols), dtype=bool)
        starts[1:] = symbols[1:] != symbols[:-1]
        if not starts.all():
            levels.append(Level(symbols, starts))
            sizes = np.diff(levels[-1].first)
            symbols = _names(symbols[levels[-1].first[:-1]] * (int(sizes.max()) + 1) + sizes)
        if len(symbols) == 1:
            break
        left = _half(symbols, seed)
        forward, backward = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
        pairs = forward if forward.sum() >= backward.sum() else backward
        seed += 1
        if not pairs.any():  # all symbols fell into one half: another seed parts them
            continue
        starts = np.ones(len(symbols), dtype=bool)
        starts[1:] = ~pairs
        levels.append(Level(symbols, starts))
        first = levels[-1].first
        second = np.where(np.diff(first) == 2, symbols[np.minimum(first[:-1] + 1, len(symbols) - 1)] + 1, 0)
        symbols = _names(symbols[first[:-1]] * (int(symbols.max()) + 2) + second)
    levels.append(Level(symbols))
    return levels


def mirror(levels: list[Level]) -> list[Level]:
    """The grammar of the reversed sequence: the same phrases read from the other end."""
    return [level.mirrored() for level in levels]


def _advance(level: Level, x: np.ndarray, y: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Step over equal symbols at two places, a run of one symbol at once; tells where a step was taken."""
    same = level.symbols[x[which]] == level.symbols[y[which]]
    moved = which[same]
    a, b = x[moved], y[moved]
    rest_a, rest_b = level.first[level.owner[a] + 1] - a, level.first[level.owner[b] + 1] - b
    uniform = (level.symbols[level.first[level.owner[a] + 1] - 1] == level.symbols[a]) & (
        level.symbols[level.first[level.owner[b] + 1] - 1] == level.symbols[b]
    )
    step = np.where(uniform, np.minimum(rest_a, rest_b), 1)
    x[moved] += step
    y[moved] += step
    return same


def common_extension(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common stretch from i and from j on, i != j, for arrays of queries.

    Both stretches must end before the sequence does: a symbol that occurs once stops them.
    """
    x, y = i.astype(np.int64), j.astype(np.int64)
    differs_at = np.full(len(x), len(levels) - 1)
    going = np.arange(len(x))
    for h, level in enumerate(levels[:-1]):
        if not len(going):
            break

        def aligned(which: np.ndarray, level: Level = level) -> np.ndarray:
            a, b = x[which], y[which]
            return (level.first[level.owner[a]] == a) & (level.first[level.owner[b]] == b)

        inside = going[~aligned(going)]
        stopped = []
        while len(inside):  # at most two turns: then both begin a phrase, or the symbols differ
            same = _advance(level, x, y, inside)
            stopped.append(inside[~same])
            inside = inside[same]
            inside = inside[~aligned(inside)]
        if stopped:
            ended = np.concatenate(stopped)
            differs_at[ended] = h
            going = np.setdiff1d(going, ended, assume_unique=True)
        x[going], y[going] = level.owner[x[going]], level.owner[y[going]]
    for h in range(len(levels) - 1, 0, -1):
        below = levels[h - 1]
        down = np.flatnonzero(differs_at >= h)
        if not len(down):
            continue
        x[down], y[down] = below.first[x[down]], below.first[y[down]]
        while len(down):  # what two different phrases share at their start
            down = down[_advance(below, x, y, down)]
    return x - i
