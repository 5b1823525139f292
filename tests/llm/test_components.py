import random

import numpy as np
import pytest

from gradus.llm.components import components, least_reached

draw = random.Random(5)
GRAPHS = {
    "path": [(i, i + 1) for i in range(40)],
    "star": [(0, i) for i in range(1, 30)],
    "star of the greatest": [(30, i) for i in range(30)],
    "random, with null and self links": [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(3, None), (7, 7)],
    "empty": [],
}


@pytest.mark.parametrize("one_task", [None, 0])
@pytest.mark.parametrize("name", GRAPHS)
def test_components_equal_union_find(spark, name, one_task):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in GRAPHS[name]:
        if b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    found = components(spark.createDataFrame(GRAPHS[name], "a long, b long").repartition(6), "a", "b", one_task).collect()
    assert {r.node: r.component for r in found} == {x: root(x) for x in up} and len(found) == len(up)


def test_nodes_that_are_texts(spark):
    links = [("b", "a"), ("c", "b"), ("x", "y"), ("z", "z"), (None, "a")]
    found = components(spark.createDataFrame(links, "a string, b string"), "a", "b").collect()
    assert {r.node: r.component for r in found} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_stars_of_many_links():
    """Folding in numpy, a long path included."""
    n = 50_000
    nodes, root = least_reached(np.arange(1, n), np.arange(n - 1))
    assert len(nodes) == n and (root == 0).all()
