import random

import pytest

from logloom.llm import components
from logloom.llm.components import connected_components

GRAPHS = {
    "path": [(i, i + 1) for i in range(90)],
    "hub": [(500 if i % 2 else 0, i) for i in range(1, 300)],
    "random": [(random.Random(i).randrange(400), random.Random(-i - 1).randrange(400)) for i in range(260)],
    "odd": [(1, 1), (None, 3), (4, None), (7, 5), (5, 7), (5, 7), (-2, 5)],
    "none": [],
}


def brute(edges):
    low = {}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = (find(low.setdefault(x, x)) for x in (a, b))
            low[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in low)


@pytest.mark.parametrize("most", [0, 1 << 18])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(components, "BROADCAST_NODES", most)
    for edges in GRAPHS.values():
        got = connected_components(spark.createDataFrame(edges, "a long, b long"))
        assert sorted((r.node, r.component) for r in got.collect()) == brute(edges)


def test_rounds_of_small_graphs_shuffle_little(spark):
    """A shuffle of a small graph has as many tasks as that of a large one, and the driver keeps something of every task."""
    shuffles = spark.sparkContext._jsc.sc().newShuffleId
    before = shuffles()
    connected_components(spark.createDataFrame(GRAPHS["path"], "a long, b long").coalesce(1))
    assert 0 < shuffles() - before < 50
