"""Projections by bits against the loop over tables."""

import random

import pytest

from provena.operators import graph
from tests.test_whole_graphs import distances, successors


@pytest.mark.parametrize("limit", [None, 1, 3])
def test_projection_by_bits_equals_the_loop(spark, monkeypatch, limit):
    chance = random.Random(3)
    edges = [(chance.randrange(400), chance.randrange(400)) for _ in range(900)] + [(5, 5), (-7, 5), (5, -7), (5, -7)]
    opaque = [(k,) for k in range(-7, 420) if k % 4 != 1] + [(5,), (5,)]
    e, o = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(opaque, "node long")
    want = sorted(map(tuple, graph.projected(e, o, limit, 0).collect()))
    assert len(want) > 300
    monkeypatch.setattr(graph, "fixpoint", None)
    assert sorted(map(tuple, graph.projected(e, o, limit).collect())) == want


def test_batches_over_slices_of_components_equal_brute_force(spark, monkeypatch):
    """Components of all sizes, a long chain, more starts than a task and a batch have, passes of a few edges."""
    chance = random.Random(4)
    edges = [(base + chance.randrange(n), base + chance.randrange(n)) for base, n in ((0, 3), (10, 90), (200, 1), (300, 40), (400, 150)) for _ in range(2 * n)]
    edges += [(1000 + k, 1001 + k) for k in range(300)]
    opaque = [(k,) for k in range(1000) if k % 3] + [(1000,), (1001,), (1300,)]
    name = lambda k: k * 7919 % 10007
    edges, opaque = {(name(a), name(b)) for a, b in edges}, {name(k) for (k,) in opaque}
    out = successors(edges)
    want = sorted((a, b, n) for a in opaque for b, n in distances(out, a, lambda x: x not in opaque).items() if b in opaque and a != b)
    assert max(n for _, _, n in want) == 299
    e, o = spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame([(k,) for k in opaque], "node long")
    for constant, value in {"WORDS": 1, "TASK_STARTS": 70, "PASS_EDGES": 50, "HELD": 5000, "fixpoint": None}.items():
        monkeypatch.setattr(graph, constant, value)
    assert sorted(map(tuple, graph.projected(e, o).collect())) == want


def test_millions_of_edges_need_no_join_for_each_hop(spark, monkeypatch):
    monkeypatch.setattr(graph, "fixpoint", None)
    e = spark.range(4_100_000).selectExpr("id as src", "if(id % 1000 = 999, id - 998, id + 1) as dst")
    got = graph.projected(e, spark.createDataFrame([(0,), (999,), (5_000,), (5_001,)], "node long")).collect()
    assert sorted(map(tuple, got)) == [(0, 999, 999), (5000, 5001, 1)]
