"""Truncated singular value decomposition of a sparse matrix that is a table of (row, word, weight).

The range of the largest right factors is found by subspace iteration from random vectors: a step multiplies a block of
|V| x (k + spare) numbers by the matrix and its transpose, row by row where the rows are, and tasks' partial products are
summed by ranges of words.  When the block has settled, the rows are projected onto it and the projection is decomposed
by a tree of QR steps: each task reduces its rows to a triangle, triangles are reduced again in groups, and the driver
decomposes the last few.  What reaches the driver is |V| x (k + spare) numbers a step, not |V| squared, whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.sources.io import scratch

RANGE = 4096  # words to a range of partial products
ENTRIES = 1 << 16  # entries multiplied at once


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, weights, entries of each row) of slices of rows."""
    for batch in batches:
        lengths = batch.column("i").value_lengths().to_numpy()
        ends = np.cumsum(lengths)
        i, w = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("i", "w"))
        at = 0
        while at < len(lengths):
            done = ends[at] - lengths[at]
            to = max(at + 1, int(np.searchsorted(ends, done + ENTRIES, side="right")))
            yield i[done : ends[to - 1]], w[done : ends[to - 1]], lengths[at:to]
            at = to


def _projected(i: np.ndarray, w: np.ndarray, lengths: np.ndarray, block: np.ndarray) -> np.ndarray:
    return np.add.reduceat(w[:, None] * block[i], np.cumsum(lengths) - lengths, axis=0)


def _square_times(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """The matrix's transpose times the matrix times the block."""
    size, width = block.shape

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, width))
        for i, w, lengths in _rows(batches):
            y = np.repeat(_projected(i, w, lengths, block), lengths, axis=0) * w[:, None]
            order = np.argsort(i, kind="stable")
            words, starts = np.unique(i[order], return_index=True)
            total[words] += np.add.reduceat(y[order], starts, axis=0)
        for at in range(0, size, RANGE):
            if total[at : at + RANGE].any():
                yield pa.RecordBatch.from_arrays([pa.array([at // RANGE], pa.int32()), pa.array([total[at : at + RANGE].tobytes()], pa.binary())], ["part", "sum"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # the ranges of this task
        for batch in batches:
            for part, sums in zip(batch.column("part").to_pylist(), batch.column("sum")):
                values = np.frombuffer(sums.as_buffer())
                held[part] = held[part] + values if part in held else values.copy()
        for part, values in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["part", "sum"])

    kinds, out = "part int, sum binary", np.zeros((size, width))
    for r in rows.mapInArrow(multiply, kinds).repartition("part").mapInArrow(add, kinds).collect():
        values = np.frombuffer(r["sum"]).reshape(-1, width)
        out[r["part"] * RANGE : r["part"] * RANGE + len(values)] = values
    return out


def _triangle(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """The triangular factor of the matrix times the block, by a tree of QR steps."""
    width = block.shape[1]

    def reduced(triangles: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for more in triangles:
            r = np.linalg.qr(np.vstack([r, more]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], ["r"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from reduced(_projected(i, w, lengths, block) for i, w, lengths in _rows(batches))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from reduced(np.frombuffer(r.as_buffer()).reshape(-1, width) for batch in batches for r in batch.column("r"))

    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    last = rows.mapInArrow(first, "r binary").repartition(groups).mapInArrow(again, "r binary").collect()
    whole = np.vstack([np.zeros((0, width)), *[np.frombuffer(r["r"]).reshape(-1, width) for r in last]])
    return np.linalg.qr(whole, mode="r") if len(whole) else np.zeros((width, width))


def fit_svd(weights: DataFrame, key: str, vocab: Sequence[str], k: int, spare: int = 64, steps: int = 300, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors) of the weight matrix, without centring, k of each or as many as words.

    Steps end when the k leading vectors are eigenvectors up to ``tolerance``, relative to the largest eigenvalue.  Each vector's
    entry of largest size is positive.  More ``spare`` vectors settle in fewer steps.
    """
    size, k = len(vocab), min(k, len(vocab))
    width = min(size, k + max(spare, k))
    spark = weights.sparkSession
    places = spark.createDataFrame(list(zip(vocab, range(size))), "gram string, __i int")  # a row per word
    entries = weights.join(F.broadcast(places), "gram").groupBy(key).agg(F.collect_list(F.struct(F.col("__i").alias("i"), F.col("w").cast("double").alias("w"))).alias("e"))
    path = scratch(spark, "matrix")
    entries.select("e.i", "e.w").write.parquet(path)
    rows = spark.read.schema("i array<int>, w array<double>").parquet(path)

    block = np.linalg.qr(np.random.default_rng(0).normal(size=(size, width)))[0]
    for _ in range(steps if size else 0):
        image = _square_times(rows, block)
        values, turn = np.linalg.eigh(block.T @ image)
        values, turn = values[::-1], turn[:, ::-1]
        apart = np.linalg.norm((image @ turn - (block @ turn) * values)[:, :k], axis=0)
        settled = width == size or apart.max(initial=0) <= tolerance * max(values[0], 1e-300)
        block = block @ turn if settled else np.linalg.qr(image)[0]
        if settled:
            break
    _, values, turn = np.linalg.svd(_triangle(rows, block))
    vectors = block @ turn.T
    values, vectors = np.concatenate([values, np.zeros(width)])[:k], vectors[:, :k]
    top = np.abs(vectors).argmax(axis=0) if size else np.zeros(0, int)
    return values, vectors * np.where(vectors[top, np.arange(k)] < 0, -1, 1)


def project_svd(weights: DataFrame, key: str, vocab: Sequence[str], vectors: np.ndarray) -> DataFrame:
    """(key, svd_0, svd_1, ...)."""
    k = vectors.shape[1]
    rows = [(g, *map(float, vectors[i])) for i, g in enumerate(vocab)]
    factors = weights.sparkSession.createDataFrame(rows, "gram string, " + ", ".join(f"f{i} double" for i in range(k)))
    return weights.join(F.broadcast(factors), "gram").groupBy(key).agg(*[F.round(F.sum(F.col("w") * F.col(f"f{i}")), 6).alias(f"svd_{i}") for i in range(k)])
