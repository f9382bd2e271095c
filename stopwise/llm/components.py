"""Connected components by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import stored

_EDGES = "a long, b long"


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of every batch by stars round the smallest node of each
    component that the batch shows. Connectivity stays as it is."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        nodes, places = np.unique(ends, return_inverse=True)
        left, right = places.reshape(2, -1)
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[left], label[right])
            new = label.copy()
            np.minimum.at(new, label[left], low)
            np.minimum.at(new, label[right], low)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        off = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(nodes[label[off]])], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node (the larger end) and its smaller neighbours to the smallest of them."""
    lowest = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(lowest, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(lowest.select("a", F.col("low").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: a node has one parent and no parent has a parent."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    seen = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return seen.filter("below > 1 or (below = 1 and above = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges`` (a, b: long);
    the component is named by its smallest node.

    Every round contracts what a batch shows by itself, then takes a large and a
    small star. Each round is a written table, so a lost executor costs one round
    at most, and the rounds grow as the logarithm of the longest path. A hot node
    is a grouped minimum with partial sums and a join whose hot partition adaptive
    execution splits. Null ends and loops are left out; no edges give no rows.
    """
    current = edges.filter("a is not null and b is not null and a != b").select("a", "b")
    while True:
        current = stored(_small_star(_large_star(current.mapInArrow(_contract, _EDGES))))
        if _settled(current):
            roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
