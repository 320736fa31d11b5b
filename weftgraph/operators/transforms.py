"""Transforms that filter, contract and thin a graph.  Each takes and returns a Graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.predicates import matched, with_end_attributes
from weftgraph.graph import Graph, segmented_ranks, unique_name
from weftgraph.operators.components import component_labels
from weftgraph.operators.structure import component_sizes, connected_components, crop_to, degrees, remove_nodes
from weftgraph.plans.iterate import cut


def remove_nodes_where(graph: Graph, condition: Column) -> Graph:
    return remove_nodes(graph, graph.nodes.where(matched(condition)).select("id"))


def keep_nodes_where(graph: Graph, condition: Column) -> Graph:
    return crop_to(graph, graph.nodes.where(matched(condition)).select("id"))


def _edges_where(graph: Graph, condition: Column, end_attributes: tuple[str, ...]) -> Graph:
    edges = with_end_attributes(graph, *end_attributes) if end_attributes else graph.edges
    return graph.with_edges(edges.where(condition).select(*graph.edges.columns))


def remove_edges_where(graph: Graph, condition: Column, end_attributes: tuple[str, ...] = ()) -> Graph:
    """``end_attributes`` are the node attributes that the condition uses as ``source.X`` or ``target.X``."""
    return _edges_where(graph, ~matched(condition), end_attributes)


def keep_edges_where(graph: Graph, condition: Column, end_attributes: tuple[str, ...] = ()) -> Graph:
    return _edges_where(graph, matched(condition), end_attributes)


def _components_where(graph: Graph, condition: Column) -> DataFrame:
    labelled = connected_components(graph)
    chosen = component_sizes(graph).where(matched(condition)).select(F.col("component").alias("chosen_"))
    return labelled.nodes.join(chosen, F.col("component") == F.col("chosen_"), "left_semi").select("id")


def remove_components_where(graph: Graph, condition: Column) -> Graph:
    """The condition may use ``num_nodes`` and ``num_edges``."""
    return remove_nodes(graph, _components_where(graph, condition))


def keep_components_where(graph: Graph, condition: Column) -> Graph:
    return crop_to(graph, _components_where(graph, condition))


def contract_edges_where(graph: Graph, condition: Column, end_attributes: tuple[str, ...] = ()) -> Graph:
    """Matching edges vanish and their ends merge, transitively.

    The head of merged nodes is the least id.  Nodes get ``head`` and ``multiplicity`` and the tails
    stay in ``nodes`` marked by ``head <> id``; edges run between heads, edges within a head go, and
    edges between the same two heads merge into the one with the least id, with a ``multiplicity``.
    """
    chosen = keep_edges_where(graph, condition, end_attributes).edges
    heads = cut(component_labels(chosen).select(F.col("id").alias("v_"), F.col("component").alias("h_")))
    nodes = graph.nodes.join(heads, F.col("id") == F.col("v_"), "left").select(*graph.nodes.columns, F.coalesce("h_", "id").alias("head"))
    sizes = nodes.groupBy(F.col("head").alias("head_")).agg(F.count("*").alias("multiplicity"))
    nodes = nodes.join(sizes, F.col("head") == F.col("head_")).drop("head_")
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(heads, F.col(end) == F.col("v_"), "left").withColumn(end, F.coalesce("h_", end)).drop("v_", "h_")
    edges = edges.where("src <> dst")
    first = F.min_by(F.struct(*edges.columns), "edge_id").alias("e")
    merged = edges.groupBy(F.least("src", "dst").alias("low_"), F.greatest("src", "dst").alias("high_")).agg(first, F.count("*").alias("multiplicity"))
    return Graph(nodes, merged.select("e.*", "multiplicity"))


def contract_by_attribute(graph: Graph, attribute: str) -> Graph:
    """Neighbours with equal values merge; equal values that are not connected stay apart."""
    return contract_edges_where(graph, F.col(f"`source.{attribute}`") == F.col(f"`target.{attribute}`"), (attribute,))


def separate_by_attribute(graph: Graph, attribute: str) -> Graph:
    """Without the edges whose ends have different values; missing equals missing."""
    return keep_edges_where(graph, F.col(f"`source.{attribute}`").eqNullSafe(F.col(f"`target.{attribute}`")), (attribute,))


def remove_leaves(graph: Graph, limit: int = 1) -> Graph:
    """``limit`` times: all nodes with at most one edge go at once."""
    for k in range(limit):
        leaves = degrees(graph).where("degree <= 1").select("id")
        graph = remove_nodes(graph, leaves)
        if k + 1 < limit:
            graph = graph.cut()
    return graph


def _rake(edges: DataFrame) -> DataFrame:
    """(e, a, b) without the edges at a node that has no other; a loop counts twice."""
    ends = edges.select("e", F.explode(F.array("a", "b")).alias("v"))
    leaves = ends.groupBy("v").agg(F.count("*").alias("n"), F.min("e").alias("e")).where("n = 1").select(F.col("e").alias("e_"))
    return cut(edges.join(leaves, F.col("e") == F.col("e_"), "left_anti"))


def _compress(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((e, a, b) with one edge for each chain, (e, chain) of all edges that a chain swallowed).

    A chain runs through nodes of degree 2; its edges are found by pointer jumping, and it is named by
    the least of them.  A ring, whose nodes all have degree 2, has no ends and is left as it is.
    """
    ends = edges.select("e", F.explode(F.array("a", "b")).alias("v"))
    through = cut(ends.groupBy("v").agg(F.count("*").alias("n"), F.min("e").alias("src"), F.max("e").alias("dst")).where("n = 2"))
    chains = cut(component_labels(through.where("src < dst")).select(F.col("id").alias("c_"), F.col("component").alias("chain")))
    tips = ends.join(chains, F.col("e") == F.col("c_")).join(through.select(F.col("v").alias("t_")), F.col("v") == F.col("t_"), "left_anti")
    short = tips.groupBy(F.col("chain").alias("e")).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    inside = cut(chains.join(short.select(F.col("e").alias("s_")), F.col("chain") == F.col("s_"), "left_semi"))
    rest = edges.join(inside, F.col("e") == F.col("c_"), "left_anti")
    return cut(rest.unionByName(short)), inside.select(F.col("c_").alias("e"), "chain")


def remove_branches(graph: Graph) -> Graph:
    """Leaves go until none is left: the 2-core, a loop counting twice.

    Rake and compress: all leaves go at once, then each chain of nodes of degree 2 becomes one edge,
    so the next rake takes a whole chain.  What hangs from the core loses half its nodes a round, so
    rounds grow with the logarithm of the graph, however long its chains are.  A node of the core has
    two of its edges, so the edges that are left say which nodes are.
    """
    left = cut(graph.edges.select(F.col("edge_id").alias("e"), F.col("src").alias("a"), F.col("dst").alias("b")))
    standing = left.select("e", F.col("e").alias("now_"))  # each edge and the one that stands for it
    size = left.count()
    while True:
        left = _rake(left)
        raked = left.count()
        if raked == size:
            break
        left, inside = _compress(left)
        standing = standing.join(inside.select(F.col("e").alias("i_"), "chain"), F.col("now_") == F.col("i_"), "left").select("e", F.coalesce("chain", "now_").alias("now_"))
        standing = cut(standing.join(left.select(F.col("e").alias("l_")), F.col("now_") == F.col("l_"), "left_semi"))
        size = left.count()
    core = cut(standing.join(left.select(F.col("e").alias("l_")), F.col("now_") == F.col("l_"), "left_semi").select(F.col("e").alias("core_")))
    edges = cut(graph.edges.join(core, F.col("edge_id") == F.col("core_"), "left_semi"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v_")).distinct()
    return Graph(graph.nodes.join(ends, F.col("id") == F.col("v_"), "left_semi"), edges)


def spanning_tree(graph: Graph) -> Graph:
    """One breadth-first tree per component from its least node; each other node keeps the least edge to the level before."""
    labelled = connected_components(graph)
    around = cut(graph.incidence().where("node <> other").select("edge_id", "node", "other"))
    seen = cut(labelled.nodes.select(F.col("component").alias("v")).distinct())
    frontier, tree = seen, None
    while True:
        next_ = around.join(frontier, F.col("other") == F.col("v")).drop("v").join(seen, F.col("node") == F.col("v"), "left_anti").groupBy("node").agg(F.min("edge_id").alias("edge_id"))
        next_ = cut(next_)
        if next_.isEmpty():
            break
        tree = next_.select("edge_id") if tree is None else tree.unionByName(next_.select("edge_id"))
        frontier = next_.select(F.col("node").alias("v"))
        seen = cut(seen.unionByName(frontier))
    if tree is None:
        return graph.with_edges(graph.edges.limit(0))
    return graph.with_edges(graph.edges.join(tree.select(F.col("edge_id").alias("kept_")), F.col("edge_id") == F.col("kept_"), "left_semi"))


def edge_reduction(graph: Graph, percentage: float = 10, minimum: int = 5) -> Graph:
    """Each node draws, with replacement, ``max(minimum, floor(degree * percentage / 100))`` of its edges; drawn edges stay.

    Draws come from a hash of node and number, so they repeat from run to run.
    """
    ranked = cut(segmented_ranks(graph.incidence().select("edge_id", "node", "side"), "node", "edge_id", "side", place="place", size="degree").select("edge_id", "node", "place", "degree"))
    draws = ranked.where("place = 1").select(F.col("node").alias("n_"), "degree", F.explode(F.expr(f"sequence(1, greatest({int(minimum)}, cast(floor(degree * {float(percentage)} / 100) as int)))")).alias("draw"))
    drawn = draws.select("n_", (F.pmod(F.xxhash64("n_", "draw"), F.col("degree")) + 1).alias("p_")).distinct()
    kept = ranked.join(drawn, (F.col("node") == F.col("n_")) & (F.col("place") == F.col("p_"))).select(F.col("edge_id").alias("kept_")).distinct()
    return graph.with_edges(graph.edges.join(kept, F.col("edge_id") == F.col("kept_"), "left_semi"))


def _nearest(graph: Graph, attribute: str, most: Column, descending: bool, prefix: str) -> Graph:
    order = F.desc_nulls_last(attribute) if descending else F.asc_nulls_last(attribute)
    ends = graph.incidence(attribute).select("edge_id", "node", "side", attribute)
    seen = segmented_ranks(ends, "node", order, "edge_id", "side", place="rank_", size="degree_")
    rank = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("rank_"))), F.lit(0)).cast("long")
    own = unique_name("kept_", graph.edges.columns)
    kept = seen.where(F.col("rank_") <= most).groupBy(F.col("edge_id").alias(own)).agg(rank("out").alias(f"{prefix} Source Rank"), rank("in").alias(f"{prefix} Target Rank"))
    a, b = F.col(f"`{prefix} Source Rank`"), F.col(f"`{prefix} Target Rank`")
    mean = F.when((a > 0) & (b > 0), (a + b) / 2).otherwise(F.greatest(a, b).cast("double"))
    return graph.with_edges(graph.edges.join(kept, F.col("edge_id") == F.col(own)).drop(own).withColumn(f"{prefix} Mean Rank", mean))


def knn_edges(graph: Graph, attribute: str, k: int = 5, descending: bool = True) -> Graph:
    """Edges among the first ``k`` of either end by an attribute, with their ranks (0: not ranked there)."""
    return _nearest(graph, attribute, F.lit(k), descending, "k-NN")


def percent_nn(graph: Graph, attribute: str, percent: float = 10, minimum: int = 5, descending: bool = True) -> Graph:
    """As ``knn_edges``, with a share of each node's edges but at least ``minimum``."""
    return _nearest(graph, attribute, F.greatest(F.floor(F.col("degree_") * percent / 100), F.lit(minimum)), descending, "%-NN")
