"""The best few of a stream of score matrices, kept for each query while a partition goes by."""

from __future__ import annotations

import numpy as np


class RunningTop:
    """Keeps the ``k`` best (score descending, then key ascending) of each of ``n`` queries.

    What is below a query's k-th best so far is passed over at once; the others wait in a
    buffer that is cut back to k a query whenever it has grown. Memory is n times k, not
    what has gone by.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.least = np.full(n, -np.inf)
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, scores: np.ndarray, keys: np.ndarray, some: np.ndarray | None = None) -> None:
        """A matrix of scores, queries by keys; only where ``some`` is set, if given."""
        take = scores >= self.least[:, None]
        if some is not None:
            take &= some
        if np.count_nonzero(take) > 4 * self.n * self.k and scores.shape[1] > self.k:
            take &= scores >= np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k, None]
        i, j = np.nonzero(take)
        self._parts.append((i, keys[j], scores[i, j]))
        self._waiting += len(i)
        if self._waiting > 4 * self.n * self.k:
            self._cut()

    def _cut(self) -> None:
        i, keys, s = (np.concatenate(x) for x in zip(*self._parts, strict=True))
        order = np.lexsort((keys, -s, i))
        i, keys, s = i[order], keys[order], s[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        full = nth == self.k - 1
        self.least[i[full]] = s[full]
        keep = nth < self.k
        self._parts = [(i[keep], keys[keep], s[keep])]
        self._waiting = int(keep.sum())

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, score) of what is left, by query and rank."""
        if not self._parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self._cut()
        return self._parts[0]
