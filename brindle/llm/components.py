"""Connected components of an edge table, without collecting edges or links anywhere.

Each partition first replaces its edges by a spanning star forest (union-find over the partition's own edges).
While more than `small` edges are left, a round of contraction follows: every node moves to the node with the smallest
hash in its closed neighbourhood, edges follow and loops go; the hash changes from round to round, so a
constant share of nodes goes in each on average, paths included.  What is left then, at most `small` edges, is
finished by one task.  All tables between the rounds are checkpointed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

#: Edges that one task may finish: 16 bytes each.
SMALL = 1_000_000


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node of each one's component."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        nodes, root = union_find(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
        some = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(root[some])], names=["u", "v"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component) of every node with an edge to another: component is the smallest node that edges reach.

    edges: two bigint columns.  Loops, repeated edges and nulls don't matter; no edges give no rows.
    """
    u, v = edges.columns
    left = edges.select(F.col(u).cast("bigint").alias("u"), F.col(v).cast("bigint").alias("v")).filter("u <> v")
    left = checkpointed(left.mapInArrow(_forest, "u bigint, v bigint"))
    moves: list[DataFrame] = []
    while left.count() > small:
        both = left.union(left.select("v", "u"))
        rank = lambda c: F.xxhash64(F.lit(len(moves)), F.col(c))  # noqa: B023, E731
        best = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("h"), F.col("v").alias("v"))).alias("m"))
        to = checkpointed(best.select("u", F.when(rank("u") < F.col("m.h"), F.col("u")).otherwise(F.col("m.v")).alias("to")))
        moves.append(to)
        left = left.join(to, "u").select(F.col("to").alias("a"), F.col("v").alias("u")).join(to, "u").select(F.col("a").alias("u"), F.col("to").alias("v"))
        left = checkpointed(left.filter("u <> v").distinct().mapInArrow(_forest, "u bigint, v bigint"))
    last = left.repartition(1).mapInArrow(_forest, "u bigint, v bigint")
    found = last.unionByName(last.select(F.col("v").alias("u"), "v").distinct())
    for to in reversed(moves):
        onward = found.select(F.col("u").alias("to"), F.col("v").alias("end"))
        found = to.join(onward, "to", "left").select("u", F.coalesce("end", "to").alias("v"))
    smallest = found.groupBy("v").agg(F.min("u").alias("component"))
    return found.join(smallest, "v").select(F.col("u").alias("node"), "component")
