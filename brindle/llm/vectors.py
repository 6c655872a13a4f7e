"""What both vector searches share: clean vectors, cells of near ones, and queries that visit the cells their bounds allow.

Queries are a stated share of all rows and candidates are all rows, so neither side is bounded.

1. A vector has a few features.  A kd-tree over the features of a sample of `SAMPLE` rows, those with the smallest hashes, cuts
   the space into cells, about one for each `candidate_block` rows; every row goes to its cell, and a cell with more rows than
   that is dealt out as several blocks.  Each cell keeps the box of its rows' features and their number.
2. A query first visits one block of the cell that looks best, which gives it a k-th best score.
3. Then it visits all blocks whose box could hold something as good, the others not.  Blocks meet at most `query_block`
   queries at a time.  The best k of all visits are the result.

Boxes are one small row for each `candidate_block` rows at least; they are collected and sent to the tasks, and routing tests
groups of FAN cells by their common box first.  Of equal vectors only the k + 1 with the smallest ids are candidates: more can't
be among the k best of any row.  So no cell is hot.

Vectors that are null or empty or hold null or non-finite components take no part, nor do rows without
vec_id.  Rows with the same vec_id count once (the smallest vector holds).  Vectors of different lengths
aren't compared.  Further columns, whatever their names, are not read.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

#: Rows that the cells are fitted on.
SAMPLE = 4096
FAN = 32


class Method(Protocol):
    """How a search sees vectors.  Matrices have a row for each vector; all vectors of a call have one length."""

    score_type: str

    def features(self, vectors: np.ndarray) -> np.ndarray: ...

    def query_features(self, queries: np.ndarray) -> np.ndarray: ...

    def closeness(self, features: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How good something in each box could be, larger is better."""

    def allowed(self, closeness: np.ndarray, queries: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Whether that could be among the best, given the k-th best known scores (-inf: none)."""

    def local(self, query_ids, queries, known, ids, vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """query_id, vec_id and score of the best in one block; and how many were computed exactly for each query."""


def clean(frame: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with v an array of doubles."""
    rows = frame.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(good & (F.size("v") > 0)).groupBy("id").agg(F.min("v").alias("v"))


def _matrices(v: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and rows of a column of vectors, by their length."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    if isinstance(v, pa.ChunkedArray):
        v = pa.concat_arrays(v.chunks) if v.num_chunks else pa.array([], v.type)
    at = v.offsets.to_numpy()
    sizes, flat = np.diff(at), v.values.to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == d)
        yield d, some, flat[at[some][:, None] + np.arange(d)]


class Cells:
    """Median splits of a sample's features along their widest side."""

    def __init__(self, features: np.ndarray, cells: int):
        self.splits: list[tuple[int, float, int, int]] = []  # side, value, and what is below and above: a split, or ~cell
        self.count = 0
        self.root = self._grow(features, cells)

    def _grow(self, some: np.ndarray, cells: int) -> int:
        spread = np.ptp(some, axis=0) if len(some) else np.zeros(1)
        if cells < 2 or len(some) < 2 or not spread.max() > 0:
            self.count += 1
            return ~(self.count - 1)
        side = int(np.argmax(spread))
        value = float(np.quantile(some[:, side], (cells // 2) / cells))
        below = some[:, side] <= value
        if below.all():
            below = some[:, side] < value
        here = len(self.splits)
        self.splits.append((side, value, 0, 0))
        left, right = self._grow(some[below], cells // 2), self._grow(some[~below], cells - cells // 2)
        self.splits[here] = (side, float(some[below, side].max()), left, right)
        return here

    def of(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros(len(features), np.int32)
        todo = [(self.root, np.arange(len(features)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                side, value, left, right = self.splits[node]
                below = features[rows, side] <= value
                todo += [(left, rows[below]), (right, rows[~below])]
        return out


_BOX = "d int, cell int, n bigint, low array<double>, high array<double>"


def _assign(method: Method, cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, cell = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for size, rows, v in _matrices(batch.column(1)):
                d[rows], cell[rows] = size, cells.of(method.features(v))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d), pa.array(cell)], names=["id", "v", "d", "cell"])

    return run


def _boxes(method: Method):
    """Boxes of what each task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            cell = batch.column(3).to_numpy()
            for d, rows, v in _matrices(batch.column(1)):
                features = method.features(v)
                for c in np.unique(cell[rows]).tolist():
                    some = features[cell[rows] == c]
                    box = found.setdefault((d, c), [0, some[0], some[0]])
                    box[:] = box[0] + len(some), np.minimum(box[1], some.min(0)), np.maximum(box[2], some.max(0))
        rows = [(d, c, n, low.tolist(), high.tolist()) for (d, c), (n, low, high) in found.items()]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["d", "cell", "n", "low", "high"])

    return run


class Router:
    """The cells' boxes of all lengths, collected."""

    def __init__(self, rows: list, block: int):
        self.by_size: dict[int, tuple] = {}
        for d in {r["d"] for r in rows}:
            own = sorted((r for r in rows if r["d"] == d), key=lambda r: r["cell"])
            cell, blocks = np.array([r["cell"] for r in own]), -(-np.array([r["n"] for r in own]) // block)
            self.by_size[d] = cell, blocks, np.array([r["low"] for r in own]), np.array([r["high"] for r in own])

    def homes(self, method: Method, d: int, queries: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell that looks best and one of its blocks."""
        cell, blocks, low, high = self.by_size[d]
        best = np.argmax(method.closeness(method.query_features(queries), low, high), 1)
        return cell[best], ids % blocks[best]

    def visits(self, method: Method, d: int, queries: np.ndarray, ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, cell and block of all visits after the first."""
        cell, blocks, low, high = self.by_size[d]
        features = method.query_features(queries)
        home_cell, home_block = self.homes(method, d, queries, ids)
        out: list[list[np.ndarray]] = [[], [], []]
        for a in range(0, len(cell), FAN):
            b = min(a + FAN, len(cell))
            near = method.closeness(features, low[a:b].min(0)[None], high[a:b].max(0)[None])
            some = np.flatnonzero(method.allowed(near, queries, known)[:, 0])
            near = method.closeness(features[some], low[a:b], high[a:b])
            q, c = np.nonzero(method.allowed(near, queries[some], known[some]))
            q, c = some[q], c + a
            q, block = np.repeat(q, blocks[c]), np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in blocks[c])])
            c = np.repeat(cell[c], blocks[c])
            other = (c != home_cell[q]) | (block != home_block[q])
            for column, x in zip(out, (q[other], c[other], block[other]), strict=True):
                column.append(x)
        return tuple(np.concatenate(x).astype(np.int64) for x in out)


_VISIT = "query_id bigint, known double, v array<double>, d int, cell int, block int"


def _routed(method: Method, router: Router, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            known = batch.column(1).to_numpy(zero_copy_only=False)
            for d, rows, v in _matrices(batch.column(2)):
                for a in range(0, len(rows), 256):
                    part = rows[a : a + 256]
                    if first:
                        q, (cell, block) = np.arange(len(part)), router.homes(method, d, v[a : a + 256], ids[part])
                    else:
                        q, cell, block = router.visits(method, d, v[a : a + 256], ids[part], known[part])
                    at = pa.array(part[q])
                    columns = [c.take(at) for c in batch.columns] + [pa.array(np.full(len(q), d), pa.int32()), pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "known", "v", "d", "cell", "block"])

    return run


_SPOT = ["d", "cell", "block"]


def _met(candidates: DataFrame, visits: DataFrame, method: Method, query_block: int) -> DataFrame:
    """(query_id, vec_id, score, verified) of all visits; a block with many visitors meets them in several parts."""
    kind = pa.int64() if method.score_type == "bigint" else pa.float64()

    def pair(some: pa.Table, wanted: pa.Table) -> pa.Table:
        columns = [np.zeros(0, np.int64)] * 4
        if some.num_rows and wanted.num_rows:
            order = np.argsort(some.column("id").to_numpy(), kind="stable")
            some = some.take(pa.array(order))
            ((_, _, vectors),), ((_, _, queries),) = _matrices(some.column("v")), _matrices(wanted.column("v"))
            columns = method.local(wanted.column("query_id").to_numpy(), queries, wanted.column("known").to_numpy(), some.column("id").to_numpy(), vectors)
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], kind), pa.array(columns[3], pa.int64())], names=["query_id", "vec_id", "score", "verified"])

    visits = checkpointed(visits)
    parts = checkpointed(visits.groupBy(*_SPOT).agg(F.ceil(F.count("*") / query_block).cast("int").alias("parts")))
    asked = visits.join(parts, _SPOT).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
    there = candidates.join(parts, _SPOT).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = there.groupBy(*_SPOT, "part").cogroup(asked.groupBy(*_SPOT, "part"))
    return met.applyInArrow(pair, f"query_id bigint, vec_id bigint, score {method.score_type}, verified bigint")


def search(vectors: DataFrame, queries_every: int, k: int, method: Method, candidate_block: int, query_block: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's best, from checkpointed (id, v)."""
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    known = [method.features(v) for _, _, v in _matrices(sample.column("v"))] if n else []
    cells = Cells(np.concatenate(known) if known else np.zeros((0, 1)), min(-(-n // candidate_block), SAMPLE // 32))
    copies = Window.partitionBy("v").orderBy("id")
    some = vectors.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).select("id", "v")
    candidates = checkpointed(some.mapInArrow(_assign(method, cells), "id bigint, v array<double>, d int, cell int"))
    boxes = candidates.mapInArrow(_boxes(method), _BOX).select("d", "cell", "n", F.posexplode(F.arrays_zip("low", "high")))
    boxes = boxes.groupBy("d", "cell", "pos").agg(F.sum("n").alias("n"), F.min("col.low").alias("low"), F.max("col.high").alias("high"))
    boxes = boxes.groupBy("d", "cell").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("box"))
    boxes = checkpointed(boxes.select("d", "cell", "n", "box.low", "box.high"))
    router = Router(boxes.collect(), candidate_block)  # a row for each cell
    # A row for each cell: Spark sends it to the tasks where it is small.
    sizes = boxes.select("d", "cell", F.ceil(F.col("n") / candidate_block).alias("blocks"))
    candidates = candidates.join(sizes, ["d", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    queries = vectors.filter(F.col("id") % queries_every == 0).select(F.col("id").alias("query_id"), F.lit(float("-inf")).alias("known"), "v")
    home = checkpointed(_met(candidates, queries.mapInArrow(_routed(method, router, True), _VISIT), method, query_block))
    least = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))
    again = queries.join(least, "query_id", "left").select("query_id", F.coalesce("least", "known").alias("known"), "v")
    more = _met(candidates, again.mapInArrow(_routed(method, router, False), _VISIT), method, query_block)
    everything = home.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    best = everything.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    return np.lexsort((ids, -scores))[:k]
