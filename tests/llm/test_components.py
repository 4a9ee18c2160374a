from __future__ import annotations

import random

import pytest

from envtally.llm.components import connected_components


def brute(edges):
    parent = {n: n for e in edges for n in e if e[0] != e[1]}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {n: root(n) for n in parent}


@pytest.mark.parametrize(
    "edges",
    [
        [], [(1, 1)], [(1, 2)], [(2, 1), (1, 2), (1, 2)], [(n, n + 1) for n in range(60)], [(0, n) for n in range(1, 80)],
        [(n, (n * 7) % 50) for n in range(50)], [(-5, 3), (3, -(1 << 63)), ((1 << 63) - 1, 9)],
    ],
)
def test_components_equal_brute_force(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == brute(edges)


def test_random_graph(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(330)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == brute(edges)
