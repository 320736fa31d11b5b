"""Writers: pairwise text, JSON elements, Parquet graphs, attribute tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators.select import natural_key


def weight_column(edges: DataFrame) -> str | None:
    """The numeric edge attribute whose name holds *weight*, or else *value*; first by alphabet."""
    numeric = sorted(c for c, t in edges.dtypes if t in ("int", "bigint", "double", "float") and c not in ("edge_id", "src", "dst"))
    for word in ("weight", "value"):
        for c in numeric:
            if word in c.lower():
                return c
    return None


def pairwise_lines(graph: Graph, weight: str | None = None) -> DataFrame:
    """(value): ``"source" "target" weight`` of each edge; quotes in names are escaped, nodes without a name show their id."""
    weight = weight or weight_column(graph.edges)
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("id").cast("string"))
    shown = graph.nodes.select(F.col("id").alias("i_"), F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('\\"')), F.lit('"')).alias("shown"))
    edges = graph.edges.join(shown.toDF("i1_", "a"), F.col("src") == F.col("i1_")).join(shown.toDF("i2_", "b"), F.col("dst") == F.col("i2_"))
    parts = [F.col("a"), F.col("b")] + ([F.col(weight).cast("string")] if weight else [])
    return edges.select(F.concat_ws(" ", *parts).alias("value"))


def write_pairwise(graph: Graph, path: str, weight: str | None = None) -> None:
    pairwise_lines(graph, weight).write.text(path)


def json_elements(graph: Graph) -> DataFrame:
    """(value): a JSON object for each node and edge, with its attributes as typed metadata."""
    rest = lambda df, *own: F.struct(*[F.col(c) for c in df.columns if c not in own]) if len(df.columns) > len(own) else F.struct(F.lit(None).cast("string").alias("none"))
    nodes = graph.nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), F.col("id").cast("string").alias("id"), F.col("name").alias("label"), rest(graph.nodes, "id", "name").alias("metadata"))).alias("value"))
    edges = graph.edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), F.col("edge_id").cast("string").alias("id"), F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), rest(graph.edges, "edge_id", "src", "dst").alias("metadata"))).alias("value"))
    return nodes.unionByName(edges)


def write_json_elements(graph: Graph, path: str) -> None:
    json_elements(graph).write.text(path)


def write_graph_parquet(graph: Graph, path: str, notes: dict | None = None) -> None:
    """``nodes``, ``edges`` and ``meta`` below one folder."""
    graph.nodes.write.parquet(f"{path}/nodes")
    graph.edges.write.parquet(f"{path}/edges")
    spark = graph.nodes.sparkSession
    spark.createDataFrame([(json.dumps(notes or {}),)], "value string").coalesce(1).write.text(f"{path}/meta")


def attribute_table(nodes: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """The chosen columns in order, sorted naturally by one of them."""
    chosen = nodes.select(*columns)
    return chosen.orderBy(natural_key(F.col(by).cast("string")), by) if by else chosen


def write_attribute_table(nodes: DataFrame, path: str, columns: list[str], by: str | None = None) -> None:
    attribute_table(nodes, columns, by).write.csv(path, header=True)
