"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Largest inner product becomes smallest distance by one component more: sqrt(M - |x|^2) for candidates, M being
the largest squared norm of all, and 0 for queries.  Vectors are projected by `m` Gaussian vectors; a projected squared
distance divided by the true one is chi-square with m degrees of freedom.

All rows are indexed by a kd-tree over their projections: its upper levels cut them into cells (vectors.py), and in each block a
tree goes on down to leaves of LEAF rows.  A query takes projected neighbours in order of their projected distance and verifies
them with the original vectors; it stops before a projected distance r where the chi-square distribution of
r / d reaches `sure`, d being the squared distance of the k-th best vector so far: one as near as that would have turned up before with
that probability.  Cells and leaves whose boxes are beyond that radius aren't entered.

Each true neighbour is missed with probability 1 - sure at most, nearer ones more seldom.  How many vectors are verified
hangs on the contrast of distances: with `m` = 32 and `sure` = 0.93 one in a hundred of clustered vectors; of vectors without
any order in 64 components, whose distances hardly differ, 27 % of 51,000, 32 % of 10,000 and 44 % of 2,000.

Scores are inner products of the original vectors in double precision, summed in order of the components; ties
go to the smaller vec_id, also where more vectors tie than a query keeps.  Zero vectors take no part; see vectors.py for
nulls, repeated rows, vectors of different lengths, clashing columns and empty tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed
from .vectors import best_of, clean, search

LEAF = 64


def chi_square(x: np.ndarray, m: int) -> np.ndarray:
    """The distribution function for an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 40.0 * m
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(np.array(middle), m) < p else (low, middle)
    return high


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products over the last axis, component after component: no row depends on its place in a block."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for i in range(a.shape[-1]):
        out += a[..., i] * b[..., i]
    return out


class KdTree:
    """Median splits along the widest side, down to leaves of LEAF points: `order` is leaf after leaf, from `starts` on."""

    def __init__(self, points: np.ndarray):
        leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            some = todo.pop()
            if len(some) <= LEAF:
                leaves.append(some)
                continue
            side = int(np.argmax(np.ptp(points[some], axis=0)))
            order = some[np.argpartition(points[some, side], len(some) // 2)]
            todo += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.order = np.concatenate(leaves)
        self.starts = np.cumsum([0, *map(len, leaves)])
        self.low = np.array([points[x].min(0) for x in leaves])
        self.high = np.array([points[x].max(0) for x in leaves])

    def inside(self, leaves: np.ndarray) -> np.ndarray:
        """Places (in `order`) of some leaves' points."""
        sizes = self.starts[leaves + 1] - self.starts[leaves]
        return np.repeat(self.starts[leaves] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def box_distances(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of queries to boxes."""
    out = np.zeros((len(queries), len(low)))
    for i in range(queries.shape[1]):
        q = queries[:, i, None]
        out += np.maximum(np.maximum(low[:, i] - q, q - high[:, i]), 0) ** 2
    return out


class Projections:
    score_type = "double"

    def __init__(self, k: int, m: int, sure: float, largest: float, seed: int):
        self.k, self.m, self.largest, self.seed = k, m, largest, seed
        self.stop = chi_square_quantile(sure, m)

    def _project(self, v: np.ndarray, extra: np.ndarray) -> np.ndarray:
        axes = np.random.default_rng([self.seed, v.shape[1]]).standard_normal((v.shape[1] + 1, self.m))
        return in_order(np.concatenate([v, extra[:, None]], 1)[:, None, :], axes.T[None])

    def features(self, vectors: np.ndarray) -> np.ndarray:
        return self._project(vectors, np.sqrt(np.maximum(self.largest - in_order(vectors, vectors), 0)))

    def query_features(self, queries: np.ndarray) -> np.ndarray:
        return self._project(queries, np.zeros(len(queries)))

    def closeness(self, features: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return -box_distances(features, low, high)

    def _radius(self, square: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The projected squared distance from where on neighbours aren't verified."""
        return np.where(known == -np.inf, np.inf, np.maximum(square + self.largest - 2 * known, 1e-12 * (square + self.largest)) * self.stop)

    def allowed(self, closeness: np.ndarray, queries: np.ndarray, known: np.ndarray) -> np.ndarray:
        return -closeness <= self._radius(in_order(queries, queries), known)[:, None]

    def local(self, query_ids, queries, known, ids, vectors):
        k = self.k
        points = self.features(vectors)
        tree = KdTree(points)
        points, vectors, ids = points[tree.order], vectors[tree.order], ids[tree.order]
        lengths = (points**2).sum(1)
        squares = in_order(queries, queries)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for begin in range(0, len(queries), 64):
            asked = self.query_features(queries[begin : begin + 64])
            far, dense = box_distances(asked, tree.low, tree.high), None
            for i, f in enumerate(asked, begin):
                q, square, least, n_verified = queries[i], squares[i], float(known[i]), 0
                turn = np.argsort(far[i - begin], kind="stable")
                radius = float(self._radius(square, np.array(least)))
                top, who = np.zeros(0), np.zeros(0, np.int64)
                place, step, waiting, distance = 0, 8, np.zeros(0, np.int64), np.zeros(0)
                while True:
                    # Leaves in order: what they hold waits until no leaf is left that could hold something nearer.
                    leaves = turn[place : place + step]
                    leaves = leaves[far[i - begin, leaves] <= radius]
                    some = tree.inside(leaves)
                    if 4 * len(some) > len(ids) and dense is None:  # most leaves of these queries: one product for all
                        dense = lengths - 2 * (asked @ points.T)
                    near = (dense[i - begin, some] if dense is not None else lengths[some] - 2 * (points[some] @ f)) + f @ f
                    inside = (near <= radius) & (ids[some] != query_ids[i])
                    waiting, distance = np.concatenate([waiting, some[inside]]), np.concatenate([distance, near[inside]])
                    place, step = place + step, 4 * step
                    last = place >= len(turn) or far[i - begin, turn[place]] > radius
                    horizon = radius if last else min(radius, far[i - begin, turn[place]])
                    ready = distance <= horizon
                    if not last and radius == np.inf and not ready.any():  # no k-th best yet: a few near ones give one
                        ready = distance <= np.partition(distance, min(2 * k, len(distance) - 1))[min(2 * k, len(distance) - 1)] if len(distance) else ready
                    order = np.flatnonzero(ready)
                    order = order[np.argsort(distance[order], kind="stable")]
                    at, batch = 0, 4 * k
                    while at < len(order) and distance[order[at]] <= radius:
                        now = order[at : at + batch]
                        now = now[distance[now] <= radius]
                        at, batch = at + batch, 2 * batch
                        n_verified += len(now)
                        top, who = np.concatenate([top, vectors[waiting[now]] @ q]), np.concatenate([who, waiting[now]])
                        if len(top) >= k:
                            best = np.partition(top, len(top) - k)[len(top) - k]
                            if best > least:
                                least = best
                                radius = float(self._radius(square, np.array(least)))
                            # All that tie with the k-th stay; sums differ in their last bits until they are redone.
                            kept = top >= least - 1e-9 * (np.sqrt(square * self.largest) + abs(least))
                            top, who = top[kept], who[kept]
                    rest = ~ready
                    waiting, distance = waiting[rest], distance[rest]
                    if place >= len(turn) or far[i - begin, turn[place]] > radius:
                        if not len(distance) or distance.min() > radius:
                            break
                scores = in_order(q[None], vectors[who])
                best = best_of(ids[who], scores, k)
                for column, x in zip(out, (np.full(len(best), query_ids[i], np.int64), ids[who[best]], scores[best], np.full(len(best), n_verified)), strict=True):
                    column.append(x)
        return tuple(np.concatenate(x) for x in out)


def nearest(frame: DataFrame, key: str = "vec_id", vector: str = "embedding", queries_every: int = 20, k: int = 20, m: int = 32, sure: float = 0.93, seed: int = 7, candidate_block: int = 16384, query_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found among all rows but the query's own."""
    vectors = checkpointed(clean(frame, key, vector).filter(F.exists("v", lambda x: x != 0)))
    largest = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    return search(vectors, queries_every, k, Projections(k, m, sure, largest, seed), candidate_block, query_block)
