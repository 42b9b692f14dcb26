"""Connected components of a graph given as an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


#: Edges that a task contracts at once: two dozen MB of arrays.
EDGES = 1 << 19


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of edges as stars around their smallest ids, without repeats."""
    nodes, at = np.unique(np.stack([a, b]), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's edges: the same components as stars, EDGES at once. Only makes later rounds fewer."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def made() -> pa.RecordBatch:
        x, y = _stars(np.concatenate(a), np.concatenate(b))
        a[:], b[:] = [x], [y]
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        if sum(map(len, a)) >= EDGES:
            out = made()
            if 2 * out.num_rows >= EDGES:  # else the stars stay, to meet the next edges
                yield out
                a[:], b[:] = a[:0], b[:0]
    if a:
        yield made()


def _contracted(edges: DataFrame) -> DataFrame:
    """Repeats go by a shuffle whose small partitions Spark joins, so that few edges are one task's and done at once."""
    return materialize(edges.distinct().mapInArrow(contract, "a long, b long"), "edges")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every neighbour above a node moves to the smallest of the node and its neighbours; and the table of minima."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")), "least")
    return materialize(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b"), "stars"), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node and its neighbours below it move to the smallest of them; and the table of minima. Edges have a > b."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("least")), "least")
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).filter("a <> b"), least


def _unsettled(edges: DataFrame) -> bool:
    """Is there a node with two parents, or a parent with a parent of its own?"""
    none = F.lit(None).cast("long")
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), none.alias("up"), F.lit(1).alias("down")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.min("e.up").alias("x"), F.max("e.up").alias("y"), F.max("e.down").alias("down"))
    return not nodes.filter("x <> y or (x is not null and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (id, component): of every node that has an edge to another, the smallest id it can reach.

    Fewer than EDGES edges are contracted in one task, at once. Of more, each task first turns its batches of edges into
    stars. A round groups by node but only takes a minimum, so that a hub is summed before it is shuffled. The minima are
    written before they are joined: with an aggregate in the join's own stage Spark could not split a hub's partition.
    Rounds grow with the logarithm of the longest path. Each is written to the shared folder. Edges with a null end, and loops, do not count; an empty table gives none.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b")
    few = edges.limit(EDGES).count() < EDGES
    edges = materialize(edges.coalesce(1).mapInArrow(contract, "a long, b long"), "edges") if few else _contracted(edges)
    while not few and _unsettled(edges):
        stars, done = _large_star(edges)
        moved, more = _small_star(stars)
        new = _contracted(moved)
        discard(edges, stars, done, more)
        edges = new
    child, root = edges.select(F.col("a").alias("id"), F.col("b").alias("component")), edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    out = materialize(child.union(root).distinct(), "components")
    discard(edges)
    return out
