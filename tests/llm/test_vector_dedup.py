"""Near-duplicates of vectors against all pairs, and recall where the margin does not cover everything."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import vector_dedup as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=V.THRESHOLD):
    sound = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) and lab is not None for _, v, lab in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for i, (_, v, lab) in enumerate(rows):
        for j in range(i):
            if sound[i] and sound[j] and lab == rows[j][2] and len(v) == len(rows[j][1]):
                a, b = np.array(v, float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    up[top(i)] = top(j)
    least = {}
    for i, (vec, _, _) in enumerate(rows):
        if vec is not None:
            least[top(i)] = min(vec, least.get(top(i), vec))
    return sorted(((vec, links[i], c := least.get(top(i)), vec == c) for i, (vec, _, _) in enumerate(rows)), key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def clouds(seed, n, dim, spread, groups):
    """Vectors around some centres, near enough for links to be common and to cross borders."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, dim))
    return centres[draw.integers(0, groups, n)] + spread * draw.normal(size=(n, dim)) * draw.random((n, 1))


def test_given_tables(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    assert rows_of(V.near_vectors(df)) == brute(rows)


@pytest.mark.parametrize(("cells", "block"), [(1, 2048), (12, 2048), (12, 7), (40, 16)])
def test_the_whole_margin_misses_nothing(spark, cells, block):
    """Chains of links across borders, over any number of cells and blocks."""
    vectors = clouds(3, 420, 6, 0.45, 30)
    rows = [(k, v.astype(np.float32).tolist(), k % 2) for k, v in enumerate(vectors)]
    got = V.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), cells=cells, margin=math.sqrt(1 - V.THRESHOLD**2), block=block)
    want = brute(rows)
    assert rows_of(got) == want and sum(r[1] for r in want) > 400


def test_recall(spark):
    """Pairs all along from 1 to the threshold and below, in many cells; the default margin finds at least 0.99 of them."""
    vectors = clouds(4, 900, 64, 0.6, 60)
    rows = [(k, v.astype(np.float32).tolist(), 0) for k, v in enumerate(vectors)]
    got = rows_of(V.near_vectors(spark.createDataFrame(rows, SCHEMA), cells=50))
    want = brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert there > 2000 and 0.99 * there <= found <= there


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [(1, a, 0), (1, a, 0), (2, b, 0), (None, a, 0), (None, [-9.0, 1.0, 0.0], 0), (3, a, 1), (4, a, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 3.0], 0), (9, [inf, 1.0, 1.0], 0), (10, [nan, 1.0, 1.0], 0), (11, [1e-30, 2e-30, 3e-30], 0), (12, [1e30, 2e30, 3e30], 0), (13, [1.0, 2.0], 0), (14, [1.0, 2.1], 0), (15, [1.0], 0), (0, [1.0, 2.0, 3.0, 0.0], 0), (16, [-0.0, 1.0, 0.0], 2), (17, [0.0, 1.0, -0.0], 2)]
    rows += [(k, [0.5, -0.5, 0.1], 5) for k in range(30, 430)]  # copies in great number
    rows += [(k, [0.5, -0.5, 0.1 + k / 1e5], 5) for k in range(430, 500)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("node", "x", "rows", "cell", "component", "u")})
    for block in (5, V.BLOCK):
        assert rows_of(V.near_vectors(df, block=block)) == brute(rows)
    empty = V.near_vectors(df.limit(0))
    assert empty.count() == 0 and empty.columns == V.near_vectors(df).columns


def test_stars_are_components():
    draw = np.random.default_rng(2)
    for n, m, p in ((9, 7, 0.1), (30, 40, 0.03), (1, 5, 0.5), (12, 1, 0.3)):
        linked = draw.random((n, m)) < p
        nodes = draw.permutation(n + m)
        got = dict(zip(*(x.tolist() for x in V.stars(linked, nodes[:n], nodes[n:]))))
        for i, j in zip(*np.nonzero(linked)):
            assert got[nodes[i]] == got[nodes[n + j]]
        assert all(root <= node for node, root in got.items()) and len(got) == n + m
