"""Rounds of few rows: seen as they are written, in one stage, the same as over all partitions."""

import itertools
import random
import warnings

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import cluster
from weftgraph.operators.components import component_labels
from weftgraph.plans import iterate

GROUPS = itertools.count()


def jobs_of(spark, work) -> int:
    group = f"small-rounds-{next(GROUPS)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def graph_of(spark, n, pairs):
    return Graph(spark.range(n), spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "edge_id long, src long, dst long"))


def test_components_of_few_edges_take_few_jobs(spark):
    path = spark.createDataFrame([(k * 37 % 200, (k + 1) * 37 % 200) for k in range(150)], "src long, dst long")
    assert jobs_of(spark, lambda: component_labels(path).collect()) <= 60


@pytest.mark.parametrize("few", [4, 1 << 16])
def test_components_whether_rounds_are_few_or_not(spark, monkeypatch, few):
    monkeypatch.setattr(iterate, "FEW", few)
    draw = random.Random(5)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(7, 7), (None, 3), (400, 401)]
    root = {v: v for p in pairs if None not in p for v in p}
    for _ in range(400):
        for a, b in pairs:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    found = {r["id"]: r["component"] for r in component_labels(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert found == root


@pytest.mark.parametrize("few", [4, 1 << 16])
def test_clusters_whether_rounds_are_few_or_not(spark, monkeypatch, few):
    monkeypatch.setattr(iterate, "FEW", few)
    pairs = [(a, b) for base in (0, 5, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 5), (9, 10)]
    for method in (cluster.louvain, cluster.mcl):
        found = {r["id"]: (r["cluster"], r["size"]) for r in method(graph_of(spark, 15, pairs)).collect()}
        assert [found[v] for v in range(15)] == [(f"Cluster {3 - v // 5}", 5) for v in range(15)] and len(set(found.values())) == 3


def test_a_markov_round_takes_few_jobs(spark):
    path = graph_of(spark, 40, [(k, k + 1) for k in range(39)])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        few, more = (jobs_of(spark, lambda: cluster.mcl(path, max_rounds=rounds, tolerance=-1.0)) for rounds in (1, 4))
    assert more - few <= 3 * 4


def test_leaves_follow_their_only_neighbour(spark, monkeypatch):
    """Ten stars on a ring: leaves are with their hubs from the start, so few trials are left, and a pair and a lone node stay as they are."""
    pairs = [(h, (h + 1) % 10) for h in range(10)] + [(h, 10 + 30 * h + k) for h in range(10) for k in range(30)] + [(400, 399)]
    trials, survey = [], cluster._survey
    monkeypatch.setattr(cluster, "_survey", lambda *a: trials.append(1) or survey(*a))
    found = {r["id"]: (r["cluster"], r["size"]) for r in cluster.louvain(graph_of(spark, 402, pairs)).collect()}
    assert all(found[10 + 30 * h + k] == found[h] for h in range(10) for k in range(30))
    assert found[399] == found[400] and found[399][1] == 2 and found[401][1] == 1
    assert len(trials) <= 12
    names = {r["i_"]: r["c_"] for r in cluster._followed(spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0), (3, 4, 2.0), (4, 3, 2.0), (5, 5, 0.0), (2, 2, 0.0)], "node long, other long, w double")).collect()}
    assert names == {0: 1, 1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_leaves_stay_free_where_they_might_not_follow(spark, monkeypatch):
    """Below a resolution of 2, or with a negative weight, a leaf need not be with its neighbour."""
    followed = []
    monkeypatch.setattr(cluster, "_followed", lambda links: followed.append(1) or pytest.fail("followed"))
    star = graph_of(spark, 4, [(0, 1), (0, 2), (0, 3)])
    assert cluster.resolution(1.0) < 2
    cluster.louvain(star, 1.0).collect()
    cluster.louvain(star.with_edges(star.edges.withColumn("w", F.when(F.col("dst") == 3, -1.0).otherwise(2.0))), weight="w").collect()
    assert not followed
