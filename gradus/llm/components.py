"""Connected components of a graph given as a table of links.

Tasks first fold their links: of what a task finds connected among them, only the link of each node to the least one stays,
so repeated links, paths and clusters shrink before anything is shuffled.  As soon as no more than ``ONE_TASK`` links are
left, one more fold of all of them is the answer, in memory of a stated bound.

A larger graph takes alternating large-star and small-star steps: a large-star step links every larger neighbour of a node to
the least node it sees, a small-star step does the same for the smaller neighbours and the node itself.  Both are a grouped
minimum (combined before the shuffle) and a join of two written tables, whose sides are plain shuffles, so the skew join of
adaptive execution can split a node with very many links; the number of links never grows.  What a step leaves is folded as
it is written, and the steps end once all links form stars or few enough are left.  No links or components reach the driver,
only their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import written

ONE_TASK = 1 << 20
FOLD = 1 << 18  # links that a task folds at once


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of each one's component), of links between whole numbers."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[left], root[right]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        left, right = left[apart], right[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


def _folded(links: DataFrame) -> DataFrame:
    """(a, b) with a > b: each task's links, ``FOLD`` at a time, as links of nodes to the least one they reach there."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def stars() -> tuple[np.ndarray, np.ndarray]:
            nodes, root = least_reached(*held)
            return nodes[nodes != root], root[nodes != root]

        for batch in batches:
            own = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            held = tuple(np.concatenate([h, o]) for h, o in zip(held, own))
            if len(held[0]) >= FOLD:
                held = stars()
                if 2 * len(held[0]) >= FOLD:  # folding no longer helps
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held)], ["a", "b"])
                    held = (held[0][:0], held[1][:0])
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([*map(pa.array, stars())], ["a", "b"])

    return links.mapInArrow(fold, "a long, b long")


def _whole(links: DataFrame) -> DataFrame:
    """The links of at most ``ONE_TASK`` as stars, from one task."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
        if parts:
            nodes, root = least_reached(*(np.concatenate(side) for side in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != root]), pa.array(root[nodes != root])], ["a", "b"])

    return links.repartition(1).mapInArrow(fold, "a long, b long")


def _star(links: DataFrame) -> DataFrame:
    """(a, b) both ways -> each a with the least node among it and its neighbours."""
    least = written(links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return links.join(least, "a")


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _star(both).where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    met = _star(links)  # a > b already
    return met.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.where("a > m").select("a", F.col("m").alias("b")))


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link down, or only links up: then each is linked to the least of its component."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.where("down > 1 or (down = 1 and up = 1)").isEmpty()


def components(links: DataFrame, a: str, b: str, one_task: int | None = None) -> DataFrame:
    """(node, component) for every node that has a link; component is the least node it can reach.

    Links may repeat, point either way, be null (no link) or join a node to itself (no link).  Nodes are whole numbers, or
    of one type that has an order: then they are numbered first, in that order.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    if dict(pairs.dtypes)["a"] not in ("bigint", "int", "smallint", "tinyint"):
        return _named(written(pairs.distinct(), "links"), one_task)
    bound = ONE_TASK if one_task is None else one_task
    left = written(_folded(pairs.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a > b")), "links")
    while left.count() > bound:
        if _stars(left):
            break
        left = written(_folded(_small(written(_large(left).distinct(), "links")).distinct()), "links")
    else:
        left = written(_whole(left), "links")
    left = left.distinct()
    roots = left.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return left.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _named(pairs: DataFrame, one_task: int | None) -> DataFrame:
    """Components of nodes that are no numbers, through numbers that keep their order."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    numbered = written(nodes.repartitionByRange("node").sortWithinPartitions("node").withColumn("number", F.monotonically_increasing_id()), "nodes")
    of = lambda c: numbered.select(F.col("node").alias(c), F.col("number").alias(f"{c}_number"))
    found = components(pairs.join(of("a"), "a").join(of("b"), "b"), "a_number", "b_number", one_task)
    named = found.join(numbered.withColumnRenamed("number", "component").withColumnRenamed("node", "least"), "component")
    return named.select(F.col("node").alias("number"), "least").join(numbered, "number").select("node", F.col("least").alias("component"))
