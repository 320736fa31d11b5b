"""Metric joins, inverted indexes of tokens and single linkage against brute force."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest

from weftgraph.operators import linkage, similarity

VECTORS = "row long, v array<double>"


def clustered(seed, n, dims, centres):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, dims))
    v = middle[draw.integers(0, centres, n)] + 0.15 * draw.normal(size=(n, dims))
    v[: n // 3] = v[0]  # a third of the rows are one point
    v[-3:] = -v[1]
    return v / np.linalg.norm(v, axis=1)[:, None]


def pairs_of(df):
    found = [(r["a"], r["b"]) for r in df.collect()]
    assert len(found) == len(set(found)) and all(a < b for a, b in found)
    return set(found)


@pytest.mark.parametrize("polarity", ["positive", "negative", "both"])
def test_metric_join(spark, polarity, monkeypatch):
    monkeypatch.setattr(similarity, "CELL", 16)
    monkeypatch.setattr(similarity, "BLOCK", 20)
    v = clustered(1, 300, 4, 9)
    df = spark.createDataFrame([(3 * k, x.tolist()) for k, x in enumerate(v)], VECTORS).repartition(3)
    r = v @ v.T
    passed = {"positive": r >= 0.97, "negative": r <= -0.97, "both": abs(r) >= 0.97}[polarity]
    assert pairs_of(similarity.all_pairs(df, 0.97, polarity)) == {(3 * a, 3 * b) for a, b in itertools.combinations(range(len(v)), 2) if passed[a, b]}


def test_metric_join_of_distances_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CELL", 8)
    v = np.random.default_rng(2).normal(size=(200, 3))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(None, [0.0, 0.0, 0.0])], VECTORS)
    near = 1 / (1 + np.linalg.norm(v[:, None] - v[None], axis=2)) >= 0.7
    assert pairs_of(similarity.all_pairs(df, 0.7, kind="euclidean")) == {(a, b) for a, b in itertools.combinations(range(200), 2) if near[a, b]}
    assert similarity.all_pairs(df.limit(0), 0.9).count() == 0
    # a threshold of 0 or less is no bound on distances
    assert similarity.reach(-1.0, "positive", "dot") is None and similarity.reach(0.0, "positive", "euclidean") is None


def test_few_pairs_of_clustered_rows_meet(spark):
    v = clustered(5, 3000, 3, 40)[1000:]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], VECTORS)
    row = similarity.pairs_compared(similarity.metric_cells(df, similarity.reach(0.99, "positive", "dot"))).first()
    assert row["all"] == 2000 * 1999 // 2 and row["compared"] < 0.3 * row["all"]


@pytest.mark.parametrize("kind", ["smc", "jaccard"])
@pytest.mark.parametrize("threshold", [0.2, 0.75])
def test_token_pairs(spark, kind, threshold, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    draw = random.Random(threshold)
    rows = [tuple(draw.choice([0, 0, 1, 2, 2, 2, draw.randint(1, 9)]) for _ in range(4)) for _ in range(90)] + [(0,) * 4] * 3 + [(2,) * 4] * 3

    def similar(x, y):
        if kind == "smc":
            return sum(a == b for a, b in zip(x, y)) / 4
        either = sum(a != 0 or b != 0 for a, b in zip(x, y))
        return sum(a == b != 0 for a, b in zip(x, y)) / max(either, 1)

    df = spark.createDataFrame([(k, list(r)) for k, r in enumerate(rows)] + [(None, [1, 1, 1, 1])], "row long, v array<long>").repartition(3)
    wanted = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if similar(rows[a], rows[b]) >= threshold}
    assert pairs_of(similarity.token_pairs(df, threshold, kind)) == wanted == pairs_of(similarity.all_pairs(df, threshold, kind=kind))


def test_the_two_token_similarities_differ_on_zero_tokens(spark):
    df = spark.createDataFrame([(1, [0, 0, 5]), (2, [0, 0, 5]), (3, [0, 7, 5])], "row long, v array<long>")
    found = lambda kind: {(r["a"], r["b"]): round(r["r"], 3) for r in similarity.token_pairs(df, 0.5, kind).collect()}
    assert found("smc") == {(1, 2): 1.0, (1, 3): 0.667, (2, 3): 0.667}
    assert found("jaccard") == {(1, 2): 1.0, (1, 3): 0.5, (2, 3): 0.5}


def in_order(distances):
    """Single linkage by merging the nearest groups one after another."""
    groups = {v: [(v, 0.0)] for pair in distances for v in pair[:2]}
    of = {v: v for v in groups}
    for a, b, distance in sorted(distances, key=lambda p: (p[2], p[0], p[1])):
        if a == b or of[a] == of[b]:
            continue
        first, second = sorted((of[a], of[b]))
        groups[first] += [(groups[second][0][0], distance), *groups[second][1:]]
        for v, _ in groups.pop(second):
            of[v] = first
    return [leaf for name in sorted(groups) for leaf in groups[name]]


def test_cluster_order(spark):
    """Distances with ties, and a lone pair that nothing joins to the others."""
    draw = random.Random(6)
    distances = [(a, b, float(draw.randint(1, 3))) for a, b in itertools.combinations(range(3, 8), 2)] + [(64, 62, 0.5), (64, 64, 0.1)]
    found = linkage.cluster_order(spark.createDataFrame(distances, "a long, b long, distance double")).orderBy("place").collect()
    assert [r["place"] for r in found] == list(range(len(found)))
    assert [(r["v"], r["height"]) for r in found] == in_order(distances)


def test_cluster_order_of_nothing(spark):
    assert linkage.cluster_order(spark.createDataFrame([], "a long, b long, distance double")).count() == 0


@pytest.mark.parametrize("kind", ["dot", "smc", "jaccard"])
def test_equal_rows_are_compared_once(spark, kind, monkeypatch):
    monkeypatch.setattr(similarity, "MEMBERS", 16)
    monkeypatch.setattr(similarity, "BLOCK", 20)
    values = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]] if kind == "dot" else [[4, 5, 6], [4, 5, 7], [1, 2, 3]]
    close = {(0, 0), (1, 1), (2, 2)} | (set() if kind == "dot" else {(0, 1)})
    of = [0] * 70 + [1] * 3 + [2] * 20
    df = spark.createDataFrame([(k, values[c]) for k, c in enumerate(of)], VECTORS if kind == "dot" else "row long, v array<long>").repartition(3)
    held = similarity.classes(df).collect()
    assert len(held) == 5 + 1 + 2 and sorted(m for r in held for m in r["members"]) == list(range(93))
    assert all(r["row"] == min(r["members"]) and len(r["members"]) <= 16 for r in held)
    assert pairs_of(similarity.all_pairs(df, 0.5, kind=kind, digits=6)) == {(a, b) for a, b in itertools.combinations(range(93), 2) if (of[a], of[b]) in close}


def test_copies_of_a_row_stay_bounded(spark):
    """Blocks grow with the input, so a row goes to no more block pairs than BLOCKS, about."""
    for n in (2000, 50000):
        rows = spark.range(n).select("id", similarity.F.array("id").alias("v"), similarity.F.array("id").alias("members"))
        assert -(-n // similarity._block_rows(rows)) <= similarity.BLOCKS


@pytest.mark.parametrize("limit", [1, 3])
def test_nearest_of_equal_rows(spark, limit, monkeypatch):
    monkeypatch.setattr(similarity, "MEMBERS", 4)
    monkeypatch.setattr(similarity, "BLOCK", 10)
    v = clustered(8, 60, 3, 5)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], VECTORS).repartition(3)
    r = np.round(np.array([[float(np.dot(x, y)) for y in v] for x in v]), 9)
    wanted = set()
    for k in range(60):
        for other in sorted((o for o in range(60) if o != k and r[k, o] >= 0.2), key=lambda o: (-abs(r[k, o]), o))[:limit]:
            wanted.add((min(k, other), max(k, other)))
    assert pairs_of(similarity.top_k_edges(similarity.all_pairs(df, 0.2, limit=limit, digits=9), limit)) == wanted


def test_a_row_goes_to_few_block_pairs(spark):
    """A dozen blocks are tasks enough; each further one is a further copy of every row in the shuffle."""
    rows = spark.range(30000).selectExpr("id as row", "array(cast(id as double)) as v", "array(id) as members")
    assert -(-30000 // similarity._block_rows(rows)) <= 12


def test_a_token_of_few_classes_and_many_rows_is_dealt(spark):
    """Classes that stand for many rows write out their squares, so a token's block pairs are tasks enough, and bounded."""
    tokens = spark.createDataFrame([(300, 300), (300, 48000), (300, 10**9), (3, 10**9), (90000, 90000)], "m long, rows long")
    assert [r[0] for r in tokens.select(similarity._token_blocks(625)).collect()] == [1, 6, similarity.BLOCKS, 3, 144]


@pytest.mark.parametrize("kind", ["smc", "jaccard"])
def test_token_pairs_of_dealt_classes(spark, kind, monkeypatch):
    monkeypatch.setattr(similarity, "ROWS", 10)
    rows = [(1 + k % 3, 1 + k % 5, 1 + k % 2) for k in range(120)]
    df = spark.createDataFrame([(k, list(r)) for k, r in enumerate(rows)], "row long, v array<long>").repartition(3)
    wanted = {(a, b) for a, b in itertools.combinations(range(120), 2) if sum(x == y for x, y in zip(rows[a], rows[b])) >= 2}
    assert pairs_of(similarity.token_pairs(df, 0.4 if kind == "jaccard" else 0.6, kind)) == wanted


def test_bars_of_slices_hold_no_scores_of_the_block_pair():
    """What nearest neighbours keep of a slice is one number a row."""
    scores = np.random.default_rng(1).random((50, 2000))
    tracemalloc.start()
    bars = [similarity._row_bars(scores + k, 3) for k in range(30)]
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < scores.nbytes
    assert all((bar == np.sort(scores + k, axis=1)[:, -3]).all() for k, bar in enumerate(bars))
    assert (similarity._row_bars(scores[:, :3], 3) == -np.inf).all()
