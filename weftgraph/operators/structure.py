"""Queries on and changes of a graph's structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators.components import component_labels


def connected_components(graph: Graph, node_filter: Column | None = None, edge_filter: Column | None = None) -> Graph:
    """The graph with a ``component`` on nodes and edges: the least node id of the connected component.

    Elements that the optional filters match are left out first, with the edges of left-out nodes.
    """
    if node_filter is not None:
        graph = remove_nodes(graph, graph.nodes.where(F.coalesce(node_filter, F.lit(False))).select("id"))
    if edge_filter is not None:
        graph = graph.with_edges(graph.edges.where(~F.coalesce(edge_filter, F.lit(False))))
    labels = component_labels(graph.edges).select(F.col("id").alias("v_"), F.col("component").alias("c_"))
    nodes = graph.nodes.join(labels, F.col("id") == F.col("v_"), "left").select(*graph.nodes.columns, F.coalesce("c_", "id").alias("component"))
    edges = graph.edges.join(labels, F.col("src") == F.col("v_")).select(*graph.edges.columns, F.col("c_").alias("component"))
    return Graph(nodes, edges)


def component_sizes(graph: Graph) -> DataFrame:
    """(component, num_nodes, num_edges)."""
    found = connected_components(graph)
    edges = found.edges.groupBy("component").agg(F.count("*").alias("e_"))
    return found.nodes.groupBy("component").agg(F.count("*").alias("num_nodes")).join(edges, "component", "left").select("component", "num_nodes", F.coalesce("e_", F.lit(0)).cast("long").alias("num_edges"))


def largest_component(graph: Graph) -> DataFrame:
    """The one row of ``component_sizes`` with most nodes; ties to the smaller component."""
    return component_sizes(graph).agg(F.max_by(F.struct("component", "num_nodes", "num_edges"), F.struct("num_nodes", -F.col("component"))).alias("c")).where("c is not null").select("c.*")


def degrees(graph: Graph) -> DataFrame:
    """(id, degree, in_degree, out_degree); a loop counts in both and nodes without edges have zeros."""
    seen = graph.incidence().groupBy("node").agg(F.count("*").alias("d"), F.count_if(F.col("side") == "in").alias("i"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    joined = graph.nodes.select("id").join(seen, F.col("id") == F.col("node"), "left")
    return joined.select("id", zero(F.col("d")).alias("degree"), zero(F.col("i")).alias("in_degree"), zero(F.col("d") - F.col("i")).alias("out_degree"))


def _ids(ids: DataFrame) -> DataFrame:
    return ids.select(F.col(ids.columns[0]).alias("wanted_")).distinct()


def sources_of(graph: Graph, ids: DataFrame) -> DataFrame:
    """(node, neighbour, edge_id) for edges into the given nodes; parallel edges repeat."""
    return graph.edges.join(_ids(ids), F.col("dst") == F.col("wanted_")).select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), "edge_id")


def targets_of(graph: Graph, ids: DataFrame) -> DataFrame:
    """(node, neighbour, edge_id) for edges out of the given nodes."""
    return graph.edges.join(_ids(ids), F.col("src") == F.col("wanted_")).select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "edge_id")


def neighbours_of(graph: Graph, ids: DataFrame) -> DataFrame:
    return sources_of(graph, ids).unionByName(targets_of(graph, ids))


def edges_between(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(a, b, edge_id) for each given pair of the first two columns, whichever way the edge runs."""
    asked = pairs.select(F.col(pairs.columns[0]).alias("a"), F.col(pairs.columns[1]).alias("b")).distinct()
    keyed = graph.edges.select("edge_id", F.least("src", "dst").alias("low_"), F.greatest("src", "dst").alias("high_"))
    return asked.join(keyed, (F.least("a", "b") == F.col("low_")) & (F.greatest("a", "b") == F.col("high_"))).select("a", "b", "edge_id")


def first_edge_between(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(a, b, edge_id, exists): the least edge of each pair, or NULL."""
    asked = pairs.select(F.col(pairs.columns[0]).alias("a"), F.col(pairs.columns[1]).alias("b")).distinct()
    found = edges_between(graph, pairs).groupBy("a", "b").agg(F.min("edge_id").alias("edge_id"))
    return asked.join(found, ["a", "b"], "left").select("a", "b", "edge_id", F.col("edge_id").isNotNull().alias("exists"))


def edges_for_nodes(graph: Graph, ids: DataFrame) -> DataFrame:
    """The edges with an end among the given nodes, each once."""
    wanted = _ids(ids)
    touched = graph.incidence().join(wanted, F.col("node") == F.col("wanted_"), "left_semi").select(F.col("edge_id").alias("touched_")).distinct()
    return graph.edges.join(touched, F.col("edge_id") == F.col("touched_"), "left_semi")


def remove_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """Without the given nodes and the edges at them."""
    gone = _ids(ids)
    edges = graph.edges.join(gone, F.col("src") == F.col("wanted_"), "left_anti").join(gone, F.col("dst") == F.col("wanted_"), "left_anti")
    return Graph(graph.nodes.join(gone, F.col("id") == F.col("wanted_"), "left_anti"), edges)


def remove_edges(graph: Graph, edge_ids: DataFrame) -> Graph:
    return graph.with_edges(graph.edges.join(_ids(edge_ids), F.col("edge_id") == F.col("wanted_"), "left_anti"))


def crop_to(graph: Graph, ids: DataFrame) -> Graph:
    """Only the given nodes and the edges between them."""
    kept = _ids(ids)
    edges = graph.edges.join(kept, F.col("src") == F.col("wanted_"), "left_semi").join(kept, F.col("dst") == F.col("wanted_"), "left_semi")
    return Graph(graph.nodes.join(kept, F.col("id") == F.col("wanted_"), "left_semi"), edges)


def add_nodes(graph: Graph, nodes: DataFrame) -> Graph:
    """With more nodes; ids that are there already are not added again."""
    new = nodes.join(graph.nodes.select(F.col("id").alias("had_")), F.col("id") == F.col("had_"), "left_anti")
    return graph.with_nodes(graph.nodes.unionByName(new, allowMissingColumns=True))


def add_edges(graph: Graph, edges: DataFrame) -> Graph:
    """With more edges; edge ids that are there already are not added again."""
    new = edges.join(graph.edges.select(F.col("edge_id").alias("had_")), F.col("edge_id") == F.col("had_"), "left_anti")
    return graph.with_edges(graph.edges.unionByName(new, allowMissingColumns=True))


#: Ids that one task of a comparison holds, about.
IDS = 1 << 20


def graph_diff(before: Graph, after: Graph) -> DataFrame:
    """(element, id, change): nodes and edges added or removed.

    Both graphs' ids are counted together in tasks of about IDS of them, however many there are.
    """
    out = None
    for element, key in (("node", "id"), ("edge", "edge_id")):
        side = lambda g, old: getattr(g, f"{element}s").select(F.col(key).alias("id"), F.lit(old).alias("old"))  # noqa: E731, B023
        ids = side(before, 1).unionByName(side(after, 0))
        tasks = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // IDS))
        counts = ids.repartition(tasks, "id").groupBy("id").agg(F.sum("old").alias("old"), F.sum(1 - F.col("old")).alias("new"))
        # a null id is like no other
        alone = lambda mine, other, change: F.when((F.col(other) == 0) | F.col("id").isNull(), F.array_repeat(F.lit(change), F.col(mine).cast("int"))).otherwise(F.array().cast("array<string>"))
        rows = counts.select(F.lit(element).alias("element"), "id", F.explode(F.concat(alone("new", "old", "added"), alone("old", "new", "removed"))).alias("change"))
        out = rows if out is None else out.unionByName(rows)
    return out


def check_consistency(graph: Graph) -> DataFrame:
    """(problem, id): edges with an end that is no node, repeated edge ids, repeated node ids."""
    nodes = graph.nodes.select(F.col("id").alias("n_"))
    lost = lambda end: graph.edges.join(nodes, F.col(end) == F.col("n_"), "left_anti").select(F.lit(f"{end} missing").alias("problem"), F.col("edge_id").alias("id"))
    again = lambda df, key, what: df.groupBy(F.col(key).alias("id")).count().where("count > 1").select(F.lit(what).alias("problem"), "id")
    return lost("src").unionByName(lost("dst")).unionByName(again(graph.edges, "edge_id", "edge repeated")).unionByName(again(graph.nodes, "id", "node repeated"))


def merge_sets(graph: Graph) -> DataFrame:
    """(head, node, kind, multiplicity) of contracted nodes: ``not``, ``head`` or ``tail``; needs the column ``head``."""
    sizes = graph.nodes.groupBy(F.col("head").alias("head_")).agg(F.count("*").alias("multiplicity"))
    kind = F.when(F.col("multiplicity") == 1, "not").when(F.col("id") == F.col("head"), "head").otherwise("tail")
    return graph.nodes.select("id", "head").join(sizes, F.col("head") == F.col("head_")).select("head", F.col("id").alias("node"), kind.alias("kind"), "multiplicity")


def expand_selection(graph: Graph, ids: DataFrame) -> DataFrame:
    """(id): the given nodes with all members of their merge sets."""
    heads = graph.nodes.join(_ids(ids), F.col("id") == F.col("wanted_"), "left_semi").select(F.col("head").alias("h_")).distinct()
    return graph.nodes.join(heads, F.col("head") == F.col("h_"), "left_semi").select("id")
