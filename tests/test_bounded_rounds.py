"""Operators whose work is bounded: rake and compress, bounds of eccentricities, Fisher's test by ratios."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from weftgraph.graph import Graph
from weftgraph.operators import enrich, metrics, structure, transforms


def graph_of(spark, n, pairs):
    nodes = spark.range(n)
    edges = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(pairs)], "edge_id long, src long, dst long")
    return Graph(nodes, edges)


def core(n, pairs):
    alive = dict(enumerate(pairs))
    while True:
        degree = Counter(v for pair in alive.values() for v in pair)
        kept = {k: p for k, p in alive.items() if degree[p[0]] > 1 and degree[p[1]] > 1}
        if len(kept) == len(alive):
            return {v for p in kept.values() for v in p}, set(kept)
        alive = kept


def random_pairs(seed, n, m):
    draw = random.Random(seed)
    return [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]


SHAPES = {
    "sparse": (40, random_pairs(1, 40, 38)),
    "denser": (40, random_pairs(2, 40, 52)),
    "loop at the end of a path": (5, [(0, 1), (1, 2), (2, 3), (3, 3)]),
    "two rings and a path between": (12, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 5), (4, 8), (8, 9), (9, 10)]),
    "parallel edges and a tail": (4, [(0, 1), (1, 0), (1, 2), (2, 3)]),
    "a ring alone, and a tree": (9, [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (5, 7), (7, 8)]),
    "no edges": (3, []),
}


def side_by_side():
    """All shapes as the components of one graph."""
    n, pairs = 0, []
    for size, own in SHAPES.values():
        pairs += [(n + a, n + b) for a, b in own]
        n += size
    return n, pairs


def test_branches_against_one_leaf_after_another(spark):
    n, pairs = side_by_side()
    left = transforms.remove_branches(graph_of(spark, n, pairs))
    nodes, edges = core(n, pairs)
    assert {r["id"] for r in left.nodes.collect()} == nodes
    assert {r["edge_id"] for r in left.edges.collect()} == edges


def test_a_long_path_goes_in_few_rounds(spark, monkeypatch):
    rounds = []
    rake = transforms._rake
    monkeypatch.setattr(transforms, "_rake", lambda edges: rounds.append(1) or rake(edges))
    path = spark.range(100_000).selectExpr("id as edge_id", "id as src", "id + 1 as dst")
    left = transforms.remove_branches(Graph(spark.range(100_001), path))
    assert left.nodes.count() == left.edges.count() == 0
    assert len(rounds) < 40


def hops(n, pairs, source):
    around = {v: set() for v in range(n)}
    for a, b in pairs:
        around[a].add(b)
        around[b].add(a)
    seen, front = {source: 0}, [source]
    while front:
        front = [w for v in front for w in around[v] if seen.setdefault(w, seen[v] + 1) == seen[v] + 1 and w not in front]
        front = list(dict.fromkeys(w for w in front if seen[w] == max(seen.values())))
    return max(seen.values())


def test_eccentricity_against_a_search_from_every_node(spark):
    n, pairs = side_by_side()
    found = {r["id"]: r["eccentricity"] for r in metrics.eccentricity(graph_of(spark, n, pairs)).collect()}
    assert found == {v: hops(n, pairs, v) for v in range(n)}


def test_eccentricity_of_some_nodes_and_few_searches(spark):
    # a star of stars
    pairs = [(1 + k // 10 if k >= 10 else 0, k + 1) for k in range(110)]
    graph = graph_of(spark, 111, pairs)
    found, searched = metrics.eccentricity_with_searches(graph)
    assert {r["id"]: r["eccentricity"] for r in found.collect()} == {v: hops(111, pairs, v) for v in range(111)}
    assert searched < 11
    asked = spark.createDataFrame([(5,), (5,), (50,), (999,)], "id long")
    assert {r["id"]: r["eccentricity"] for r in metrics.eccentricity(graph, asked).collect()} == {5: hops(111, pairs, 5), 50: hops(111, pairs, 50)}


def by_factorials(both, row, column, n):
    f = lambda x: math.lgamma(x + 1)
    terms = {k: f(row) + f(n - row) + f(column) + f(n - column) - f(n) - f(k) - f(row - k) - f(column - k) - f(n - row - column + k) for k in range(max(0, row + column - n), min(row, column) + 1)}
    return min(1.0, sum(math.exp(t) for t in terms.values() if t <= terms[both] + 1e-9))


def test_fisher_by_ratios_against_factorials():
    draw = np.random.default_rng(0)
    for _ in range(300):
        n = int(draw.integers(1, 400))
        row, column = int(draw.integers(0, n + 1)), int(draw.integers(0, n + 1))
        both = int(draw.integers(max(0, row + column - n), min(row, column) + 1))
        assert enrich._fisher(both, row, column, n) == pytest.approx(by_factorials(both, row, column, n), rel=1e-9, abs=1e-300)


def test_fisher_of_large_counts():
    n = 100_000_000
    assert enrich._fisher(25_000_000, n // 2, n // 2, n) == pytest.approx(1.0)
    # far from the likeliest table the normal distribution is close
    z = 4 * (25_010_000 - 25_000_000) / math.sqrt(n)
    assert enrich._fisher(25_010_000, n // 2, n // 2, n) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=0.01)
    assert enrich._fisher(30_000_000, n // 2, n // 2, n) == 0.0


def test_graph_diff_holds_a_bounded_number_of_ids_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(structure, "IDS", 64)
    nodes = spark.range(1000).union(spark.createDataFrame([(None,), (5000,), (5000,)], "id long"))
    edges = spark.createDataFrame([(k, k, k + 1) for k in range(300)], "edge_id long, src long, dst long")
    found = structure.graph_diff(Graph(nodes, edges), Graph(nodes.where("id is null or id <> 5000").union(spark.range(7000, 7001)), edges.where("edge_id % 100 <> 7")))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("node", None, "added"), ("node", None, "removed"), ("node", 5000, "removed"), ("node", 5000, "removed"), ("node", 7000, "added"), ("edge", 7, "removed"), ("edge", 107, "removed"), ("edge", 207, "removed")], key=str)
    assert found.rdd.getNumPartitions() >= 2 * 1000 // 64
