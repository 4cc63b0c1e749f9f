"""Reachability and spreading with one step or several in a job, against a plain search."""

import random

import pytest

from factloom.operators import graph


def search(edges, seeds, depth):
    level = {s: 0 for s in seeds}
    frontier, step = set(seeds), 0
    while frontier and (depth is None or step < depth):
        step += 1
        frontier = {d for s, d in edges if s in frontier and s != d} - level.keys()
        level |= {n: step for n in frontier}
    return level


@pytest.mark.parametrize("few", [0, 10**6])
@pytest.mark.parametrize("depth", [0, 1, 3, 4, 5, None])
def test_reach_levels(spark, monkeypatch, few, depth):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    rng = random.Random(depth or 9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(14)] + [(114, 100), (7, 7)]
    seeds = [0, 5, 100, 300]
    got = graph.reach_levels(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(s,) for s in [*seeds, 0]], "node int"), depth).collect()
    assert {r.node: r.level for r in got} == search(edges, seeds, depth) and len(got) == len({r.node for r in got})


@pytest.mark.parametrize("few", [0, 10**6])
@pytest.mark.parametrize("rounds", [2, None])
def test_spread(spark, monkeypatch, few, rounds):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    rng = random.Random(3)
    edges = [(rng.choice("ab"), rng.randrange(30), rng.randrange(30)) for _ in range(60)] + [("a", 40 + i, 41 + i) for i in range(9)]
    seeds = [("a", 0), ("b", 1), ("a", 40), ("c", 0)]
    got = graph.spread(spark.createDataFrame(edges, "k string, src int, dst int"), spark.createDataFrame(seeds, "k string, node int"), ["k"], rounds).collect()
    want = {(k, n) for k, s in seeds for n in search([(a, b) for q, a, b in edges if q == k], [s], rounds)}
    assert {(r.k, r.node) for r in got} == want and len(got) == len(want)
