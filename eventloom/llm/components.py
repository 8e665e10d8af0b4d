"""Connected components of a graph that no one machine holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import materialised


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of the edges a - b that are not the smallest of their component."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root[root], root):
            root = root[root]
        if np.array_equal(root[x], root[y]):
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition as stars: at most one edge per node, the same components."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = forest(np.append(a, batch.column(0).to_numpy()), np.append(b, batch.column(1).to_numpy()))
    if len(a):
        yield pa.RecordBatch.from_pydict({"u": a, "v": b})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u long, v long) that is not the smallest of its component.

    Alternating large and small stars: each round links every node's larger neighbours, then its
    smaller ones, to the smallest, until the edges no longer change. Rounds grow with the
    logarithm of the longest chain; each is written to the shared folder, so a lost executor
    costs one round at most.
    """
    edges = materialised(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(_contract, "u long, v long").distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialised(least.select("u", F.col("m").alias("v")).unionByName(down).distinct())
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
    return tuple(row)
