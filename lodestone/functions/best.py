"""The best of many candidates for each of many queries, kept while blocks of candidates go by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


class Best:
    """Up to ``limit`` candidates for each of ``m`` queries: larger score to nine places, then smaller id."""

    def __init__(self, m: int, limit: int):
        self.ids, self.scores = np.zeros((m, limit), np.int64), np.full((m, limit), -np.inf)
        self.floor = np.full(m, -np.inf)  # what a candidate must reach to enter

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        enter = scores.round(9) >= self.floor[query]
        query, ids, scores = query[enter], ids[enter], scores[enter]
        if not len(query):
            return
        some, limit = np.unique(query), self.ids.shape[1]
        q, i, s = np.concatenate([np.repeat(some, limit), query]), np.concatenate([self.ids[some].ravel(), ids]), np.concatenate([self.scores[some].ravel(), scores])
        order = np.lexsort((i, -s.round(9), q))
        top = np.searchsorted(q[order], some)[:, None] + np.arange(limit)
        self.ids[some], self.scores[some] = i[order][top], s[order][top]
        self.floor[some] = self.scores[some, -1].round(9)

    def batches(self, schema: pa.Schema, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
        """``query number, id, score`` of what is held."""
        query, place = np.nonzero(self.scores > -np.inf)
        for k in range(0, len(query), rows):
            part = query[k : k + rows], place[k : k + rows]
            yield pa.RecordBatch.from_arrays([pa.array(part[0]).cast(schema.types[0]), pa.array(self.ids[part]).cast(schema.types[1]), pa.array(self.scores[part])], schema=schema)
