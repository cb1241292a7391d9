"""Exact top k per query inside a task, for scoring jobs that emit k rows per query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


class TopK:
    """Best k (score, key) per query over offered score matrices; ties go to the lower key."""

    def __init__(self, queries: int, k: int, above: float = -np.inf):
        self.k = k
        self.floor = np.full(queries, above)
        self.scores: list[np.ndarray] = [np.empty(0)] * queries
        self.keys: list[np.ndarray | None] = [None] * queries

    def offer(self, scores: np.ndarray, keys: np.ndarray) -> None:
        if not len(keys):
            return
        for j in np.flatnonzero(scores.max(axis=0) >= self.floor):
            pos = np.flatnonzero(scores[:, j] >= self.floor[j])
            s, ks = scores[pos, j], keys[pos]
            if self.keys[j] is not None:
                s, ks = np.concatenate([self.scores[j], s]), np.concatenate([self.keys[j], ks])
            order = np.lexsort((ks, -s))[: self.k]
            self.scores[j], self.keys[j] = s[order], ks[order]
            if len(order) == self.k:
                self.floor[j] = max(self.floor[j], s[order[-1]])

    def frame(self, query_name: str, ids: np.ndarray, key_name: str) -> Iterator[pd.DataFrame]:
        found = [j for j in range(len(ids)) if self.keys[j] is not None]
        if found:
            yield pd.DataFrame({
                query_name: np.concatenate([np.repeat(ids[j:j + 1], len(self.keys[j])) for j in found]),
                key_name: np.concatenate([self.keys[j] for j in found]),
                "score": np.concatenate([self.scores[j] for j in found])})
