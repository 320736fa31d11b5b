"""Readers: delimited text, edge lists, matrices, JSON and GraphML graphs, Parquet graphs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.graph import Graph, dense_ids
from weftgraph.plans.iterate import cut

DELIMITERS = {"csv": ",", "tsv": "\t", "ssv": ";"}


def read_delimited(spark: SparkSession, path: str, kind: str = "csv", header: bool = True) -> DataFrame:
    """A table of text columns.  ``txt`` splits at runs of spaces or tabs outside double quotes; an empty cell is missing.

    The header is the first line alone: a later row that equals it is a row.
    """
    if kind != "txt":
        return spark.read.csv(path, sep=DELIMITERS[kind], header=header, quote='"', escape='"', mode="PERMISSIVE", inferSchema=False)
    lines = spark.read.text(path).where(F.length(F.trim(F.translate("value", "\t", " "))) > 0)
    cells = lines.select(F.transform(F.regexp_extract_all("value", F.lit('"[^"]*"|[^ \t"]+'), F.lit(0)), lambda x: F.regexp_replace(x, '^"|"$', "")).alias("c"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    first = cells.orderBy("at").first()
    names = first["c"] if header and first else [f"_c{k}" for k in range(len(first["c"]) if first else 0)]
    head = F.lit(False)
    if header and first:
        path, block, number = first["at"]
        head = (F.col("at.file_path") == path) & (F.col("at.file_block_start") == block) & (F.col("at").getField(cells.schema["at"].dataType.names[2]) == number)
    rows = cells.where(~head)
    return rows.select(*[F.get("c", F.lit(k)).alias(n) for k, n in enumerate(names)])


def _with_order(df: DataFrame) -> DataFrame:
    return df.withColumn("row_no_", F.monotonically_increasing_id())


def read_pairwise(df: DataFrame, source: str, target: str, edge_attributes: tuple[str, ...] = (), source_attributes: tuple[str, ...] = (), target_attributes: tuple[str, ...] = ()) -> Graph:
    """A graph with an edge for each row of a table of pairs, by the roles of its columns.

    Node key and name are the cell's text; of a node attribute the value of the last row that has
    one counts.  Rows without source or target are left out.
    """
    rows = cut(_with_order(df.where(F.col(source).isNotNull() & F.col(target).isNotNull())))
    attributes = sorted({*source_attributes, *target_attributes})

    def side(key: str, own: tuple[str, ...]) -> DataFrame:
        return rows.select(F.col(key).cast("string").alias("name"), "row_no_", *[(F.col(a).cast("string") if a in own else F.lit(None).cast("string")).alias(a) for a in attributes])

    both = side(source, source_attributes).unionByName(side(target, target_attributes))
    last = [F.max_by(a, F.when(F.col(a).isNotNull(), F.col("row_no_"))).alias(a) for a in attributes]
    nodes = both.groupBy("name").agg(*last) if last else both.select("name").distinct()
    nodes = cut(dense_ids(nodes, "name"))
    ids = nodes.select("id", "name")
    named = rows.select(F.col(source).cast("string").alias("s_"), F.col(target).cast("string").alias("t_"), "row_no_", *edge_attributes)
    edges = named.join(ids.toDF("src", "sn_"), F.col("s_") == F.col("sn_")).join(ids.toDF("dst", "tn_"), F.col("t_") == F.col("tn_")).select("row_no_", "src", "dst", *edge_attributes)
    return Graph(nodes, cut(dense_ids(edges, "row_no_", name="edge_id").drop("row_no_")))


def read_edge_list(df: DataFrame, minimum: float = 0.0, filter_duplicates: bool = False) -> DataFrame:
    """(src, dst, Edge Weight, Absolute Edge Weight) of a table of two integers and a number.

    A weight that is no finite number is 0, and |weight| must exceed ``minimum``.  With
    ``filter_duplicates`` only the largest |weight| between two nodes stays.
    """
    a, b, w = df.columns[:3]
    weight = F.col(w).try_cast("double")
    finite = F.when(weight.isNull() | F.isnan(weight) | (F.abs(weight) == float("inf")), F.lit(0.0)).otherwise(weight)
    rows = df.select(F.col(a).try_cast("long").alias("src"), F.col(b).try_cast("long").alias("dst"), finite.alias("w")).where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.abs("w") > minimum))
    if filter_duplicates:
        best = F.max_by(F.struct("src", "dst", "w"), F.struct(F.abs("w"), F.col("w"), -F.col("src"))).alias("e")
        rows = rows.groupBy(F.least("src", "dst").alias("l_"), F.greatest("src", "dst").alias("g_")).agg(best).select("e.*")
    return rows.select("src", "dst", F.col("w").alias("Edge Weight"), F.abs("w").alias("Absolute Edge Weight"))


def read_adjacency_matrix(df: DataFrame, name_col: str | None = None, minimum: float = 0.0) -> DataFrame:
    """(source, target, Edge Weight): an edge from column to row for each cell with |weight| over ``minimum``.

    Rows are named by ``name_col``, or ``Node n`` in the order read; columns by the header.
    """
    columns = [c for c in df.columns if c != name_col]
    named = df if name_col else dense_ids(_with_order(df), "row_no_", name="n_").withColumn("name_", F.concat(F.lit("Node "), (F.col("n_") + 1).cast("string")))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).try_cast("double").alias("w")) for c in columns])).alias("cell")
    return named.select(F.col(name_col or "name_").cast("string").alias("target"), cells).where(F.abs("cell.w") > minimum).select("cell.source", "target", F.col("cell.w").alias("Edge Weight"))


def sniff_delimiter(spark: SparkSession, folder: str, lines: int = 6, apart: int = 3) -> DataFrame:
    """(file, delimiter) for every file of a folder, from its first lines.

    A delimiter needs 2 columns in each line and numbers of columns at most ``apart`` apart; the
    extension's own is preferred, then the one with most columns.
    """
    text = spark.read.text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    head = text.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("block", "at"))).where(F.col("n") <= lines)
    candidates = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(d).alias("delimiter"), F.size(F.split("value", f"[{d}]", -1)).alias("columns")) for k, d in DELIMITERS.items()])).alias("c")
    scored = head.select("file", candidates).groupBy("file", "c.kind", "c.delimiter").agg(F.min("c.columns").alias("lo"), F.max("c.columns").alias("hi")).where(f"lo >= 2 and hi - lo <= {apart}")
    order = Window.partitionBy("file").orderBy(F.desc(F.endswith("file", F.concat(F.lit("."), F.col("kind")))), F.desc("lo"), "kind")
    return scored.withColumn("r", F.row_number().over(order)).where("r = 1").select("file", "delimiter")


def read_json_graph(spark: SparkSession, path: str) -> Graph:
    """``{"graph": {"nodes": [...], "edges": [...]}}``, or the first of ``graphs``; ids are text, metadata become text columns.

    An edge to an unknown node is an error.
    """
    element = "struct<id:string,label:string,source:string,target:string,metadata:map<string,string>>"
    graph = f"struct<nodes:array<{element}>,edges:array<{element}>>"
    held = spark.read.schema(f"graph {graph}, graphs array<{graph}>").json(path, multiLine=True).select(F.coalesce("graph", F.get("graphs", F.lit(0))).alias("g"))

    def spread(df: DataFrame, *columns: str) -> DataFrame:
        keys = [r[0] for r in df.select(F.explode(F.map_keys("metadata"))).distinct().orderBy("col").collect()]
        return df.select(*columns, *[F.col("metadata")[k].alias(k) for k in keys if k not in columns])

    nodes = held.select(F.explode("g.nodes").alias("n")).select(F.col("n.id").alias("key"), F.coalesce("n.label", "n.id").alias("name"), F.col("n.metadata").alias("metadata"))
    nodes = cut(dense_ids(spread(nodes, "key", "name").dropDuplicates(["key"]), "key"))
    ends = _with_order(spread(held.select(F.explode("g.edges").alias("e")).select("e.source", "e.target", "e.metadata"), "source", "target"))
    ids = nodes.select("id", "key")
    edges = ends.join(ids.toDF("src", "sk_"), F.col("source") == F.col("sk_"), "left").join(ids.toDF("dst", "tk_"), F.col("target") == F.col("tk_"), "left").drop("sk_", "tk_")
    edges = cut(dense_ids(edges, "row_no_", name="edge_id").drop("row_no_"))
    lost = edges.where("src is null or dst is null").first()
    if lost:
        raise ValueError(f"edge to an unknown node: {lost['source']} to {lost['target']}")
    return Graph(nodes, edges.drop("source", "target"))


def read_graphml(spark: SparkSession, path: str) -> Graph:
    """Nodes, edges and keyed data of a GraphML file; edges to unknown nodes are dropped, a repeated node id is an error."""
    data = "data array<struct<_key:string,_VALUE:string>>"
    tag = lambda name, schema: spark.read.format("xml").option("rowTag", name).schema(schema).load(path)
    keys = {r["_id"]: (r["_for"] or "all", r["_name"]) for r in tag("key", "_id string, _for string, `_attr.name` string").select("_id", "_for", F.col("`_attr.name`").alias("_name")).collect()}

    def spread(df: DataFrame, side: str, *columns: str) -> DataFrame:
        held = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(d["_key"], d["_VALUE"])))
        own = {k: n for k, (f, n) in keys.items() if f in (side, "all") and n}
        return df.withColumn("m_", held).select(*columns, *[F.col("m_")[k].alias(n) for k, n in own.items() if n not in columns])

    nodes = spread(tag("node", f"_id string, {data}").withColumn("key", F.col("_id")), "node", "key")
    nodes = cut(nodes)
    if not nodes.groupBy("key").count().where("count > 1").isEmpty():
        raise ValueError("a node id is repeated")
    nodes = cut(dense_ids(nodes.withColumn("name", F.col("key")), "key"))
    ends = _with_order(spread(tag("edge", f"_source string, _target string, {data}"), "edge", "_source", "_target"))
    ids = nodes.select("id", "key")
    edges = ends.join(ids.toDF("src", "sk_"), F.col("_source") == F.col("sk_")).join(ids.toDF("dst", "tk_"), F.col("_target") == F.col("tk_")).drop("sk_", "tk_", "_source", "_target")
    return Graph(nodes, cut(dense_ids(edges, "row_no_", name="edge_id").drop("row_no_")))


def read_graph_parquet(spark: SparkSession, path: str) -> tuple[Graph, dict]:
    """A saved graph with its notes (such as the list of transforms)."""
    notes = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")), notes
