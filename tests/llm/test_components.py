import random

import pytest

from stopwise.llm.components import connected_components


def _expected(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


CASES = {
    "none": [],
    "nulls_and_loops": [(None, 1), (2, None), (3, 3)],
    "path": [(i, i + 1) for i in range(300)],
    "star": [(500, i) for i in range(200)],
    "random": [tuple(random.Random(s).sample(range(-200, 200), 2)) for s in range(250)],
    "repeated": [(1, 2), (2, 1), (1, 2), (7, -5)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    edges = spark.createDataFrame(CASES[name], "a long, b long").repartition(7)
    found = [tuple(r) for r in connected_components(edges).collect()]
    assert sorted(found) == sorted(_expected(CASES[name]).items())
