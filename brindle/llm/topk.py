"""Exact top-k search by multi-resolution segment statistics.

Components become integers floor(256 x) and the score is their inner product.  For a vector cut into segments
of length L with means m and deviations s (root of the summed squares around the mean), the squared distance is at
least the sum of L (m_q - m_x)^2 + (s_q - s_x)^2, which with the norms bounds the score from above by the sum of
L m_q m_x + s_q s_x.  With more segments the bound falls.

Cells of near vectors are cut by the statistics of `COARSE` segments, and a query visits a cell only where the best point
of its box could score as high as the query's k-th best so far (see vectors.py).  In a block the bound is tried with 1, 2, 4 ...
segments, each level for the survivors of the one before: a candidate whose bound falls below the k-th best known score
goes, and what survives all levels is computed exactly.  Without a known score the candidates with the best coarse bounds
give the first.  A level that drops less than one in SELDOM of what it sees, over the block's first queries, is left out
for the rest: that changes the work, not the result.

All scores are integers (below 2**53 by matrix arithmetic, beyond that by Python's; those outside 64 bits are set to
its ends), ties go to the smaller vec_id.  See vectors.py for nulls, repeated rows, clashing columns and empty tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .shared import checkpointed
from .vectors import best_of, clean, search

_LONG = 2**63 - 1
#: Segments of the statistics that cells are cut by.
COARSE = 4
SELDOM, TRIAL = 50, 16


def _statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations, so that two rows' product is the bound."""
    edges = np.linspace(0, v.shape[1], segments + 1).astype(int)
    parts = [v[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    means = [p.mean(1) for p in parts]
    return np.stack([m * np.sqrt(p.shape[1]) for m, p in zip(means, parts, strict=True)] + [np.sqrt(((p - m[:, None]) ** 2).sum(1)) for m, p in zip(means, parts, strict=True)], 1)


def _large(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int):
    """Without bounds and rounding, for components that are too large for them."""
    out: list[tuple[int, int, int, int]] = []
    exact = [[int(x) for x in v] for v in vectors]
    for name, q in zip(query_ids.tolist(), queries, strict=True):
        q = [int(x) for x in q]
        rated = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), int(x)) for v, x in zip(exact, ids, strict=True) if x != name)
        out += [(name, x, max(-_LONG - 1, min(_LONG, -s)), len(ids)) for s, x in rated[:k]]
    return tuple(np.array([r[c] for r in out], np.int64) for c in range(4))


class SegmentBounds:
    score_type = "bigint"

    def __init__(self, k: int):
        self.k = k

    def features(self, vectors: np.ndarray) -> np.ndarray:
        """COARSE means and deviations; shorter vectors' missing ones are 0."""
        found = _statistics(np.floor(vectors * 256), min(COARSE, vectors.shape[1]))
        return np.pad(found, ((0, 0), (0, 2 * COARSE - found.shape[1])))

    query_features = features

    def closeness(self, features: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), len(low)))
        for i in range(features.shape[1]):
            q = features[:, i, None]
            out += np.maximum(q * low[:, i], q * high[:, i])
        return out

    def allowed(self, closeness: np.ndarray, queries: np.ndarray, known: np.ndarray) -> np.ndarray:
        return closeness + 1e-9 * np.abs(closeness) + 1e-6 >= known[:, None] - 1e-9 * np.abs(known[:, None])

    def local(self, query_ids, queries, known, ids, vectors):
        queries, vectors = np.floor(queries * 256), np.floor(vectors * 256)
        if np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1] >= 2**52:
            return _large(queries, vectors, ids, query_ids, self.k)
        return self.descend(query_ids, queries, known, ids, vectors)[0]

    def descend(self, query_ids, queries, known, ids, vectors):
        """What local gives, and how many candidates each query saw at each level, the exact one last (-1: left out)."""
        k, d, n = self.k, queries.shape[1], len(ids)
        levels = [s for s in (1, 2, 4, 8, 16, 32) if s * 2 <= d] or [1]
        of_query, of_vector = ([_statistics(m, s) for s in levels] for m in (queries, vectors))
        slack = 1e-9 * np.sqrt((queries**2).sum(1)) * np.sqrt((vectors**2).sum(1).max()) + 1e-6
        seen = np.full((len(queries), len(levels) + 1), -1)
        met, gone, used = np.zeros(len(levels)), np.zeros(len(levels)), np.ones(len(levels), bool)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for i, (name, q) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
            alive = np.flatnonzero(ids != name)
            least = known[i]
            if least == -np.inf and len(alive) > k:
                bound = of_vector[-1][alive] @ of_query[-1][i]
                top = alive[np.argpartition(-bound, min(4 * k, len(alive) - 1))[: 4 * k]]
                scores = vectors[top] @ q
                least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else least
            if i == TRIAL:
                used = gone * SELDOM >= met
            for level in np.flatnonzero(used).tolist():
                seen[i, level] = len(alive)
                rows = of_vector[level] if len(alive) == n else of_vector[level][alive]
                kept = alive[rows @ of_query[level][i] + slack[i] >= least]
                met[level] += len(alive)
                gone[level] += len(alive) - len(kept)
                alive = kept
            seen[i, -1] = len(alive)
            scores = vectors[alive] @ q
            best = best_of(ids[alive], scores, k)
            out[0].append(np.full(len(best), name, np.int64))
            out[1].append(ids[alive[best]])
            out[2].append(scores[best].astype(np.int64))
            out[3].append(np.full(len(best), len(alive)))
        return tuple(np.concatenate(x) for x in out), seen


def top_k(frame: DataFrame, key: str = "vec_id", vector: str = "embedding", queries_every: int = 50, k: int = 5, candidate_block: int = 8192, query_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest scores among all rows but its own."""
    return search(checkpointed(clean(frame, key, vector)), queries_every, k, SegmentBounds(k), candidate_block, query_block)
