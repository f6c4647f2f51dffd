"""The best rows of many queries over batches of candidates, inside one task.

What a task keeps is ``k`` rows for each query, whatever it reads; the least of them is the bound that
later candidates must reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def ranks(keys: pa.Array) -> tuple[np.ndarray, int]:
    """The place of each key in the order of distinct keys, and how often the commonest key occurs."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), 0
    if pa.types.is_struct(keys.type):
        own = [tuple(r.values()) for r in keys.to_pylist()]
        place = {v: i for i, v in enumerate(sorted(set(own)))}
        at = np.array([place[v] for v in own])
    else:
        coded = keys.dictionary_encode("encode")
        order = np.asarray(pc.sort_indices(coded.dictionary, null_placement="at_start"))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        at = place[np.asarray(coded.indices)]
    return at, int(np.bincount(at).max())


def first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest scores, the first ones among equals; in no order."""
    if len(score) <= k:
        return np.arange(len(score))
    least = np.partition(score, -k)[-k]
    over = np.flatnonzero(score > least)
    return np.concatenate([over, np.flatnonzero(score == least)[: k - len(over)]])


class Best:
    """The ``k`` greatest scores of each of ``n`` queries, ties to the smaller key, repeated keys once."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.least = np.full(n, -np.inf)
        self._kept: tuple[np.ndarray, np.ndarray, pa.Array] | None = None
        self._new: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self._waiting = 0

    def add(self, query: np.ndarray, score: np.ndarray, keys: pa.Array) -> None:
        if not len(query):
            return
        self._new.append((query, score, keys))
        self._waiting += len(query)
        if self._waiting >= max(1000, self.n * self.k // 2):
            self._settle()

    def _settle(self) -> None:
        parts = ([self._kept] if self._kept else []) + self._new
        self._new, self._waiting = [], 0
        query, score = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
        keys = pa.concat_arrays([p[2] for p in parts])
        at, _ = ranks(keys)
        order = np.lexsort((-score, at, query))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (query[order][1:] == query[order][:-1]) & (at[order][1:] == at[order][:-1])
        order = order[~same]
        order = order[np.lexsort((at[order], -score[order], query[order]))]
        own = query[order]
        begin = np.searchsorted(own, np.arange(self.n))
        order = order[np.arange(len(own)) - begin[own] < self.k]
        self._kept = (query[order], score[order], keys.take(pa.array(order)))
        end = np.searchsorted(self._kept[0], np.arange(self.n), side="right")
        full = np.flatnonzero(np.bincount(self._kept[0], minlength=self.n) == self.k)
        self.least[full] = self._kept[1][end[full] - 1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        """``(query, score, key)`` by query, the best first; None if nothing came."""
        if self._new:
            self._settle()
        return self._kept
