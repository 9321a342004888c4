"""Connected components of the links that one task has found."""

from __future__ import annotations

import numpy as np


class Links:
    """Links among n nodes, kept as stars once they become many."""

    def __init__(self, n: int, most: int = 2_000_000):
        self.n, self.most = n, most
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.left.append(a)
            self.right.append(b)
            self.held += len(a)
            if self.held > self.most:
                self.stars()

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, root) for every node that is not the smallest of its component."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = np.concatenate(self.left), np.concatenate(self.right)
        labels = np.arange(self.n)
        while True:
            low = np.minimum(labels[a], labels[b])
            before = labels.copy()
            # Hook the roots, so that whole trees move at once, then shorten the paths.
            np.minimum.at(labels, before[a], low)
            np.minimum.at(labels, before[b], low)
            while True:
                jumped = labels[labels]
                if np.array_equal(jumped, labels):
                    break
                labels = jumped
            if np.array_equal(labels, before):
                break
        moved = np.flatnonzero(labels != np.arange(self.n))
        self.left, self.right, self.held = [moved], [labels[moved]], len(moved)
        return moved, labels[moved]
