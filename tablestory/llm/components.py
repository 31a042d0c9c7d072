"""Connected components of a link table, by spanning forests and alternating star contractions.

Tasks first replace their links by a spanning forest of them. While more than ``ONE_TASK`` edges are
left, rounds of two grouped minima and two joins contract them, on edges that only get fewer: a hub's
edges are aggregated before they are shuffled, and adaptive execution splits its part of a join. At
most ``ONE_TASK`` edges are labelled by one task, which saves the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ONE_TASK = 1 << 20


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """Nodes, the place of each one's root, and which edges joined two components."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(names)))
    kept = []
    for k, (i, j) in enumerate(zip(place[:len(a)].tolist(), place[len(a):].tolist())):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[max(i, j)] = min(i, j)
            kept.append(k)
    for i in range(len(parent)):
        parent[i] = parent[parent[i]]
    return names, parent, kept


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components as the given ones, at most one less than their ends."""
    kept = np.array(_joined(a, b)[2], np.int64)
    return a[kept], b[kept]


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every end of an edge with the least node of its component."""
    names, parent, _ = _joined(a, b)
    return names, names[np.array(parent, np.int64)]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as a spanning forest, held in pieces."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = (np.concatenate([x, np.asarray(batch.column(k))]) for k, x in enumerate((a, b)))
        if len(a) >= ONE_TASK:
            yield _batch(*forest(a, b), "a", "b")
            a, b = a[:0], b[:0]
    yield _batch(*forest(a, b), "a", "b")


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least node of each node's component; all edges in one partition."""
    held = [np.zeros((0, 2), np.int64)] + [np.stack([np.asarray(t.column(0)), np.asarray(t.column(1))], axis=1) for t in batches]
    a, b = np.concatenate(held).T
    yield _batch(*labels(a, b), "node", "component")


def _batch(x: np.ndarray, y: np.ndarray, *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], list(names))


def components(links: DataFrame, a: str, b: str, one_task: int = ONE_TASK) -> DataFrame:
    """``(node, component)`` for every node with a link to another; the component is its least node.

    Nulls and links of a node to itself are left out. The result is a checkpoint.
    """
    x, y = F.col(a), F.col(b)
    edges = links.where(x.isNotNull() & y.isNotNull() & (x != y))
    edges = edges.select(F.greatest(x, y).cast("bigint").alias("a"), F.least(x, y).cast("bigint").alias("b"))
    edges = edges.mapInArrow(_forests, "a bigint, b bigint").distinct().checkpoint()
    mark = None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found[0] <= one_task:
            return edges.repartition(1).mapInArrow(_labels, "node bigint, component bigint").checkpoint()
        if tuple(found) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = tuple(found)
        edges = _small_star(_large_star(edges)).checkpoint()
