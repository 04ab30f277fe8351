"""Which rows of one task are tied together."""

from __future__ import annotations

import numpy as np

from pageloom.llm.common import by_value

by_value(__name__)


class Forest:
    def __init__(self) -> None:
        self.parent = np.arange(1024)
        self.size = 0

    def more(self, n: int) -> np.ndarray:
        """The numbers of ``n`` more rows."""
        while self.size + n > len(self.parent):
            more = np.arange(len(self.parent), 2 * len(self.parent))
            self.parent = np.concatenate([self.parent, more])
        self.size += n
        return np.arange(self.size - n, self.size)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        found = self.parent[rows]
        while True:
            up = self.parent[found]
            if (up == found).all():
                break
            found = up
        self.parent[rows] = found
        return found

    def root(self, row: int) -> int:
        while self.parent[row] != row:
            self.parent[row] = self.parent[self.parent[row]]
            row = int(self.parent[row])
        return row

    def tie(self, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
        """Tie ``a[i]`` to ``b[j]`` wherever ``near[i, j]``; gives the places ``(i, j)`` that tied
        what was apart, fewer than there are rows."""
        used = []
        while True:
            apart = near & (self.roots(a)[:, None] != self.roots(b)[None, :])
            rows = np.flatnonzero(apart.any(axis=1))
            if not len(rows):
                return used
            for i, j in zip(rows.tolist(), apart[rows].argmax(axis=1).tolist()):
                x, y = self.root(int(a[i])), self.root(int(b[j]))
                if x != y:
                    self.parent[max(x, y)] = min(x, y)
                    used.append((i, j))
