"""Operator 7: exact top-k inner-product search with multi-resolution segment statistics.

Vectors become integers, floor(256 x).  The inner product is (|q|^2 + |x|^2 - |q - x|^2) / 2, and for any cut into
segments the squared distance is at least the sum over segments of length * ((difference of means)^2 + (difference of
deviations)^2).  So segment means and deviations bound the score from above: first with one segment, then with 4, 16 and
32 where the dimension allows.  A pair whose bound lies below the query's k-th best score so far is done with; survivors
go to the next resolution, and those of the finest get their exact score.  Where a query has no k-th score yet, the
candidates with the highest bounds are scored first.  ``Best.alive`` counts the pairs that reach each step.

Queries are dealt to groups of ``GROUP``, all vectors to shares of as many rows (of ``SHARE`` at least), and a task takes one
group and one share (a stated query set against all rows, in blocks): it holds the group, streams the share in blocks of
``BLOCK`` vectors, and keeps the k best of each query, so later blocks meet high thresholds.  A vector is sent once a group,
a query once a share, under keys of (dimension, group, share), so no key holds more than a group and a share whatever the
input, and neither side is broadcast.  The k best of all shares are ranked at the end.

How much the bounds prune depends on the vectors: segments tell apart what differs in level or spread somewhere, while
vectors without such structure (independent components of one scale) reach the exact score nearly all; the README has
figures of both.

Edge cases: vectors that are null or hold null or non-finite components take no part; equal scores go to the smaller
id; vectors are compared with those of their own dimension only, those without components score 0; a query is never
its own result, but a row that repeats its id isn't either; a query with fewer than k others gets all; empty tables
give empty results; other columns are ignored.  Scores are exact integers as long as they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm.common import table

K = 5
BLOCK = 1024
GROUP, SHARE = 1 << 16, 1 << 13
RESOLUTIONS = (1, 4, 16, 32)


class Block:
    """Integer vectors with their segment statistics from coarse to fine."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.floats = vectors.astype(np.float64)
        self.norms = (self.floats**2).sum(axis=1)
        self.exact = bool(len(vectors)) and float(np.abs(self.floats).max(initial=0)) ** 2 * vectors.shape[1] < 2**52
        self.levels = []
        for segments in RESOLUTIONS:
            if vectors.shape[1] and segments <= vectors.shape[1]:
                cuts = np.linspace(0, vectors.shape[1], segments + 1).astype(int)
                length = np.diff(cuts).astype(float)
                mean = np.add.reduceat(self.floats, cuts[:-1], axis=1) / length
                square = np.add.reduceat(self.floats**2, cuts[:-1], axis=1) / length
                root = np.sqrt(length)
                self.levels.append(np.hstack([mean * root, np.sqrt(np.maximum(square - mean**2, 0)) * root]))

    def bounds(self, rows: np.ndarray, other: Block, columns: np.ndarray, level: int) -> np.ndarray:
        """Upper bounds of the scores of some vectors with some of another block, with room for rounding."""
        top = self.norms[rows, None] + other.norms[columns]
        if not self.levels:
            return top / 2
        a, b = self.levels[level][rows], other.levels[level][columns]
        gap = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (a @ b.T)
        return (top - gap) / 2 + 1e-9 * top + 1e-6

    def scores(self, other: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact scores of pairs: by one product of matrices where the pairs are a good part of it, else pair by pair."""
        if not len(i):
            return np.zeros(0, np.int64)
        if not (self.exact and other.exact):
            return np.einsum("nd,nd->n", self.vectors[i], other.vectors[j])
        rows, r = np.unique(i, return_inverse=True)
        columns, c = np.unique(j, return_inverse=True)
        if len(i) * 16 >= len(rows) * len(columns):
            return (self.floats[rows] @ other.floats[columns].T)[r, c].astype(np.int64)
        return np.einsum("nd,nd->n", self.floats[i], other.floats[j]).astype(np.int64)


class Best:
    """The k best candidates of each query of one block so far."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k, n = queries, k, len(queries.ids)
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.filled = np.zeros((n, k), bool)
        self.alive = np.zeros(len(RESOLUTIONS) + 1, np.int64)  # pairs that each resolution was asked about, and that were scored

    def meet(self, candidates: Block) -> None:
        q, every = self.queries, np.arange(len(candidates.ids))
        finest = max(0, len(q.levels) - 1)
        for at in range(0, len(q.ids), 128):  # a slice of queries against the block
            rows = np.arange(at, min(at + 128, len(q.ids)))
            alive, columns = np.ones((len(rows), len(every)), bool), every
            if not self.filled[rows].all() and len(every) > 8 * self.k:  # the most promising give a first threshold
                best = np.argpartition(-q.bounds(rows, candidates, every, finest), 4 * self.k, axis=1)[:, : 4 * self.k]
                self._take(candidates, rows, np.repeat(np.arange(len(rows)), 4 * self.k), best.ravel())
                alive[np.arange(len(rows))[:, None], best] = False
            least = np.where(self.filled[rows, -1], self.score[rows, -1], np.iinfo(np.int64).min).astype(float)[:, None]
            for level in range(finest + 1 if q.levels else 0):
                self.alive[level] += alive.sum()
                alive[:, columns] &= q.bounds(rows, candidates, columns, level) >= least
                columns = np.flatnonzero(alive.any(axis=0))
            self._take(candidates, rows, *np.nonzero(alive))

    def _take(self, candidates: Block, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Score pairs exactly and keep the best."""
        self.alive[-1] += len(i)
        keep = self.queries.ids[rows[i]] != candidates.ids[j]
        i, j = i[keep], j[keep]
        score = self.queries.scores(candidates, rows[i], j)
        keep = ~self.filled[rows[i], -1] | (score >= self.score[rows[i], -1])
        self._merge(rows, i[keep], candidates.ids[j[keep]], score[keep])

    def _merge(self, rows: np.ndarray, i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        held = self.filled[rows]
        hi, hk = np.nonzero(held)
        i, ids, score = np.concatenate([hi, i]), np.concatenate([self.ids[rows][hi, hk], ids]), np.concatenate([self.score[rows][hi, hk], score])
        order = np.lexsort((ids, -score, i))
        i, ids, score = i[order], ids[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < self.k
        i, place = i[keep], place[keep]
        self.score[rows[i], place], self.ids[rows[i], place], self.filled[rows[i], place] = score[keep], ids[keep], True


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, v): the vectors that take part, as integers."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(x.isNotNull() & sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(c * 256).cast("long")).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, group: int = GROUP, share: int = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best others of each query."""
    rows = integer_vectors(vectors, id_col, vector_col)
    queries = integer_vectors(vectors.where(is_query), id_col, vector_col)
    n, m = rows.count(), queries.count()
    groups, shares = max(1, -(-m // group)), max(1, -(-n // max(share, min(m, group))))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    hashed = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    asked = queries.select("dim", hashed(groups).alias("group"), each(shares).alias("share"), F.lit(0).alias("met"), "id", "v")
    offered = rows.select("dim", each(groups).alias("group"), hashed(shares).alias("share"), F.lit(1).alias("met"), "id", "v")
    keys = ["dim", "group", "share"]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, best = None, [], []  # the queries of this key, until the first vector meets them

        def results() -> Iterator[pa.RecordBatch]:
            for own in best:
                i, place = np.nonzero(own.filled)
                yield pa.RecordBatch.from_arrays([pa.array(own.queries.ids[i]), pa.array(own.ids[i, place]), pa.array(own.score[i, place])], ["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            dims, *others = (batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "met"))
            change = np.any([c[1:] != c[:-1] for c in (dims, *others)], axis=0)
            bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                own, dim = (int(dims[a]), int(others[0][a]), int(others[1][a])), int(dims[a])
                if own != key:
                    yield from results()
                    key, held, best = own, [], []
                for at in range(a, b, BLOCK):
                    size = min(BLOCK, b - at)
                    v = batch.column("v").slice(at, size).flatten().to_numpy(zero_copy_only=False).reshape(size, dim)
                    block = Block(batch.column("id").slice(at, size).to_numpy(), v)
                    if not others[2][a]:
                        held.append(block)
                        continue
                    best = best or [Best(q, k) for q in held]
                    for q in best:
                        q.meet(block)
        yield from results()

    met = asked.unionByName(offered).repartition(*keys).sortWithinPartitions(*keys, "met")
    found = met.mapInArrow(searched, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5"""
