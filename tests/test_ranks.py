"""Numbers and places of rows over ranges, with hubs."""

import random

from pyspark.sql import functions as F

from weftgraph.graph import Graph, dense_ids, segmented_ranks
from weftgraph.operators import transforms


def test_dense_ids_follow_the_order(spark):
    rows = [(k * 37 % 101, f"v{k}") for k in range(101)]
    df = spark.createDataFrame(rows, "x long, v string").repartition(7)
    assert sorted(map(tuple, dense_ids(df, "x").collect())) == [(x, x, v) for x, v in sorted(rows)]
    assert dense_ids(df.limit(0), "x").count() == 0
    down = dense_ids(df, F.desc("x"), name="n").collect()
    assert all(r["n"] == 100 - r["x"] for r in down)


def test_segmented_ranks_of_a_hub_and_of_null(spark):
    draw = random.Random(4)
    rows = [(draw.choice([None, 1, 1, 1, 1, 1, 1, 2, 3]), draw.randint(0, 10**6), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g long, x long, k long").repartition(5)
    places = {r["k"]: (r["place_"], r["size_"]) for r in segmented_ranks(df, "g", F.desc("x"), "k").collect()}
    for g in (None, 1, 2, 3):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [places[r[2]] for r in own] == [(n + 1, len(own)) for n in range(len(own))]


def test_no_task_ranks_a_whole_hub(spark):
    """A star of a million edges: exact ranks, and the hub's edges are dealt over all ranges."""
    n = 1_000_000
    edges = spark.range(n).select(F.col("id").alias("edge_id"), F.lit(0).cast("long").alias("src"), (F.col("id") + 1).alias("dst"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("w"))
    graph = Graph(spark.range(n + 1).withColumn("name", F.col("id").cast("string")), edges)
    ranked = segmented_ranks(graph.incidence("w").select("edge_id", "node", "side", "w"), "node", F.desc("w"), "edge_id", "side")
    assert ranked.where((F.col("node") == 0) & (F.col("place_") != n - F.col("w"))).count() == 0
    near = transforms.knn_edges(graph, "w", 3).edges
    assert near.count() == n  # every leaf has one edge only
    assert sorted(r["w"] for r in near.where("`k-NN Source Rank` > 0").collect()) == [n - 3, n - 2, n - 1]
    share = transforms.percent_nn(graph, "w", 10).edges.where("`%-NN Source Rank` > 0")
    assert share.count() == n // 10 and share.agg(F.min("w")).first()[0] == n - n // 10


def test_edge_reduction_keeps_between_one_and_its_draws(spark):
    draw = random.Random(9)
    rows = [(k, draw.randint(0, 5) if k % 3 else 0, draw.randint(0, 300)) for k in range(2000)]
    graph = Graph(spark.range(301).withColumn("name", F.col("id").cast("string")), spark.createDataFrame(rows, "edge_id long, src long, dst long"))
    kept = {r["edge_id"] for r in transforms.edge_reduction(graph, 10, 2).edges.collect()}
    assert kept == {r["edge_id"] for r in transforms.edge_reduction(graph, 10, 2).edges.collect()}
    ends = {}
    for e, a, b in rows:
        ends.setdefault(a, []).append(e)
        ends.setdefault(b, []).append(e)
    draws = {v: max(2, len(own) * 10 // 100) for v, own in ends.items()}
    assert all(any(e in kept for e in own) for own in ends.values())
    assert len(kept) <= sum(draws.values())
