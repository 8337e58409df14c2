"""The best few of many candidates for each of a block of queries, within one task."""

from __future__ import annotations

import numpy as np


class Best:
    """Keeps, for each query, the ``limit`` candidates of highest score, ties by the lesser document.

    Candidates that cannot be among them any more are turned away at once; what is held
    is bounded by a few times queries x limit.
    """

    def __init__(self, queries: int, limit: int) -> None:
        self.queries, self.limit = queries, limit
        self.least = np.full(queries, -np.inf)
        self.pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of documents (rows) for all queries (columns); only positive ones count."""
        at, which = np.nonzero((scores > 0) & (scores >= self.least))
        if len(at):
            self.pool.append((which, docs[at], scores[at, which]))
            self.held += len(at)
            if self.held > 4 * self.queries * self.limit + 4096:
                self._cut()

    def _cut(self) -> None:
        which, docs, scores = (np.concatenate(x) for x in zip(*self.pool))
        order = np.lexsort((docs, -scores, which))
        which, docs, scores = which[order], docs[order], scores[order]
        first = np.searchsorted(which, which, "left")
        nth = np.arange(len(which)) - first
        keep = nth < self.limit
        last = nth == self.limit - 1
        self.least[which[last]] = scores[last]
        self.pool = [(which[keep], docs[keep], scores[keep])]
        self.held = int(keep.sum())

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, document, score) of what is left."""
        if not self.pool:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self._cut()
        return self.pool[0]
