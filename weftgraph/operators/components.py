"""Connected components by contraction: hook to the least neighbour, jump to the root, relabel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.iterate import counted


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``parent`` to its end for every ``v``; parents are smaller, so there is one."""
    while True:
        up = parents.select(F.col("v").alias("u_"), F.col("parent").alias("up_")).hint("merge")
        jumped, seen = counted(
            parents.join(up, F.col("parent") == F.col("u_"), "left").select("v", F.coalesce("up_", "parent").alias("parent"), (F.coalesce("up_", "parent") != F.col("parent")).alias("moved")),
            moved=F.max("moved"),
        )
        parents = jumped.select("v", "parent")
        if not seen["moved"]:
            return parents


def component_labels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every vertex that has an edge; a component is named by its least vertex.

    Direction, loops, repeated edges and edges with a null end don't matter.  Each round every
    vertex takes its least neighbour as parent if that is smaller, roots are found by pointer
    jumping, and edges are carried to the roots; edges inside a root drop out.  The rounds grow
    with the logarithm of the longest chain, and only edges between different roots stay.
    What a round asks is seen as its rows are written, and rounds of few rows need no exchange
    (``counted``); no join is broadcast, so the driver holds nothing of them.
    """
    between, _ = counted(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct())
    ends = between.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    between = between.where("a < b")
    labels = None
    while True:
        hooks = between.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("parent"))
        parents = _roots(counted(hooks)[0])
        if labels is None:
            labels = parents
        else:
            up = parents.select(F.col("v").alias("v_"), F.col("parent").alias("root_")).hint("merge")
            moved = labels.join(up, F.col("parent") == F.col("v_"), "left").select("v", F.coalesce("root_", "parent").alias("parent"))
            labels, _ = counted(moved.unionByName(parents.join(labels.select(F.col("v").alias("l_")).hint("merge"), F.col("v") == F.col("l_"), "left_anti")))
        root = lambda name, other: parents.select(F.col("v").alias(name), F.col("parent").alias(other)).hint("merge")
        lifted = between.join(root("va", "ra"), F.col("a") == F.col("va"), "left").join(root("vb", "rb"), F.col("b") == F.col("vb"), "left")
        lifted = lifted.select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).where("x <> y")
        between, seen = counted(lifted.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if not seen["rows"]:
            break
    return ends.join(labels.hint("merge"), F.col("id") == F.col("v"), "left").select("id", F.coalesce("parent", "id").alias("component"))
