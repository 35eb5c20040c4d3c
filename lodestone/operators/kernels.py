"""Arrays in a task: the best of each query so far."""

from __future__ import annotations

import numpy as np

#: Candidates that wait before the best are picked anew.
WAITING = 1 << 18


def rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves away from 0, as SQL rounds."""
    return np.trunc(x * 1e6 + np.copysign(0.5, x)) / 1e6 + 0.0


class Best:
    """The k best (score, docid) of each of some queries, over any number of batches.

    Better is the larger score, rounded to six digits, then the smaller docid. A
    candidate below a query's k-th best is dropped at once.
    """

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.kth = np.full(queries, -np.inf)  # rounded
        self._kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, query: np.ndarray, docid: np.ndarray, score: np.ndarray) -> None:
        hold = rounded(score) >= self.kth[query]
        self._kept.append((query[hold], docid[hold], score[hold]))
        self._waiting += int(hold.sum())
        if self._waiting > max(WAITING, len(self._kept[0][0])):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, docid, score) of the best so far, by query and best first."""
        if not self._kept:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        query, docid, score = (np.concatenate(x) for x in zip(*self._kept, strict=True))
        tie = np.unique(docid, return_inverse=True)[1]
        order = np.lexsort((tie, -rounded(score), query))
        query = query[order]
        first = np.searchsorted(query, query, "left")
        place = np.arange(len(query)) - first
        last = np.flatnonzero(place == self.k - 1)
        self.kth[query[last]] = rounded(score[order[last]])
        kept = order[place < self.k]
        best = query[place < self.k], docid[kept], score[kept]
        self._kept, self._waiting = [best], 0
        return best
