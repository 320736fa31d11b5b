"""Single-linkage clustering over the cluster: spanning tree, merges, and the order of the leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import dense_ids, segmented_ranks
from weftgraph.operators.components import component_labels
from weftgraph.plans.iterate import cut


def minimum_spanning_tree(distances: DataFrame) -> DataFrame:
    """The edges (a, b, distance) of the minimum spanning forest, ties to the lesser (a, b).

    Boruvka rounds: every component takes its least edge out, and the components that these join
    become one.  Components at least halve in a round.  Edges without a distance or between a
    vertex and itself don't count.
    """
    crossing = cut(distances.where("distance is not null and a <> b").select("a", "b", "distance", F.col("a").alias("x"), F.col("b").alias("y")))
    parts = [crossing.select("a", "b", "distance").limit(0)]
    while True:
        ends = crossing.select(F.explode(F.array("x", "y")).alias("c"), F.struct("distance", "a", "b", "x", "y").alias("e"))
        least = cut(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        if least.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        parts.append(least.select("a", "b", "distance"))
        labels = component_labels(least, "x", "y")
        for end in ("x", "y"):
            crossing = crossing.join(labels.toDF("i_", "c_"), F.col(end) == F.col("i_"), "left").withColumn(end, F.coalesce("c_", end)).drop("i_", "c_")
        crossing = cut(crossing.where("x <> y"))


def merges(tree: DataFrame) -> DataFrame:
    """(step, distance, kept, lost): the merges of single linkage in order, each group named by its least member.

    Edges of a spanning forest are merges in the order of their distances; what groups they join
    depends on all before.  The order is cut in half, and each half again: edges of the upper half
    are carried to the components of the lower half, and both go on by themselves.  After as many
    levels as the number of edges has bits, every edge lies between the groups that it joins.  All
    parts of a level are worked on together, so a level is one labelling of components.
    """
    ranked = dense_ids(tree, "distance", "a", "b", name="step")
    state = ranked.select("step", "distance", F.col("a").alias("x"), F.col("b").alias("y"))
    for level in range((state.count() - 1).bit_length() - 1 if not state.isEmpty() else -1, -1, -1):
        # a vertex of one part is another one than in the next part
        at = lambda end, level=level: F.struct(F.shiftright("step", level + 1).alias("part"), F.col(end).alias("v"))
        upper = F.shiftright("step", level).bitwiseAND(1) == 1
        lower = state.where(~upper)
        labels = cut(component_labels(lower.select(at("x").alias("src"), at("y").alias("dst"))))
        carried = state.where(upper)
        for end in ("x", "y"):
            carried = carried.join(labels.toDF("i_", "c_"), at(end) == F.col("i_"), "left").withColumn(end, F.coalesce("c_.v", end)).drop("i_", "c_")
        state = cut(lower.unionByName(carried))
    return state.select("step", "distance", F.least("x", "y").alias("kept"), F.greatest("x", "y").alias("lost"))


def preorder(tree: DataFrame) -> DataFrame:
    """(v, place): the places from 0 of (v, parent, rank) in a walk that takes children by rank; roots have no parent and come by rank too.

    The walk is a list of goings in and out of vertices; places come from pointer jumping, in as
    many rounds as their number has bits.  Children of one parent are ranked over all tasks.
    """
    ranked = cut(segmented_ranks(tree.select("v", "parent", "rank"), "parent", "rank", place="turn"))
    first = ranked.where("turn = 1 and parent is not null").select(F.col("parent").alias("p_"), F.col("v").alias("down"))
    after = ranked.select(F.col("parent").alias("q_"), (F.col("turn") - 1).alias("t_"), F.col("v").alias("beside"))
    around = ranked.join(first, F.col("v") == F.col("p_"), "left").join(after, F.col("parent").eqNullSafe(F.col("q_")) & (F.col("turn") == F.col("t_")), "left")
    into, out = F.lit(0), F.lit(1)
    steps = F.array(
        F.struct(F.col("v"), into.alias("side"), F.coalesce("down", "v").alias("to"), F.when(F.col("down").isNull(), out).otherwise(into).alias("to_side"), F.lit(1).cast("long").alias("left")),
        F.struct(F.col("v"), out.alias("side"), F.coalesce("beside", "parent").alias("to"), F.when(F.col("beside").isNull(), out).otherwise(into).alias("to_side"), F.lit(0).cast("long").alias("left")),
    )
    walk = cut(around.select(F.explode(steps).alias("s")).select("s.*"))
    while not walk.where("to is not null").isEmpty():
        ahead = walk.select(F.col("v").alias("v_"), F.col("side").alias("s_"), F.col("to").alias("to_"), F.col("to_side").alias("ts_"), F.col("left").alias("l_"))
        joined = walk.join(ahead, (F.col("to") == F.col("v_")) & (F.col("to_side") == F.col("s_")), "left")
        walk = cut(joined.select("v", "side", F.col("to_").alias("to"), F.col("ts_").alias("to_side"), (F.col("left") + F.coalesce("l_", F.lit(0))).alias("left")))
    return walk.where("side = 0").select("v", (F.lit(ranked.count()) - F.col("left")).alias("place"))


def cluster_order(distances: DataFrame) -> DataFrame:
    """(place, v, height): the leaves of the single-linkage tree of (a, b, distance), and where each joins those before it.

    In a merge the group with the lesser member comes first, and ``height`` of the other one's first
    leaf is its distance; the first leaf of all, and of each group that nothing joins to the others,
    has 0.  Ties are merged in the order of (a, b).  Vertices are those of the pairs.
    """
    found = cut(merges(minimum_spanning_tree(distances)))
    members = distances.select(F.explode(F.array("a", "b")).alias("v")).where("v is not null").distinct()
    joined = cut(members.join(found, F.col("v") == F.col("lost"), "left").select("v", F.col("kept").alias("parent"), F.coalesce("step", F.col("v").cast("long")).alias("rank"), F.coalesce("distance", F.lit(0.0)).alias("height")))
    places = preorder(joined).select(F.col("v").alias("v_"), "place")
    return joined.join(places, F.col("v") == F.col("v_")).select("place", "v", "height")
