import random

import pytest

from lodestar.llm.components import Forest, connected_components


@pytest.mark.parametrize("hub", [50_000, 5])
def test_chains_stars_and_loops(spark, monkeypatch, hub):
    monkeypatch.setattr("lodestar.llm.components.HUB", hub)
    random.seed(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7), (9, 8), (8, 9), (9, 8)]
    edges += [(random.randrange(1000, 1200), random.randrange(1000, 1200)) for _ in range(90)]
    random.shuffle(edges)
    f = Forest()
    for u, v in edges:
        f.join(u, v)
    nodes = {x for u, v in edges if u != v for x in (u, v)}
    got = {r.id: r.component_id for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert got == {x: f.root(x) for x in nodes}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
