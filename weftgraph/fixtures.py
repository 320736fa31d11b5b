"""Graphs and matrices made of the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph, dense_ids, graph_from_tables
from weftgraph.operators.matrix import long_form

#: The order priorities, which are the columns of the ``spend`` matrix.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def supply_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part").select(key("P", "p_partkey").alias("key"), F.lit("part").alias("kind"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("worth"))
    supplier = table(spark, sf_dir, "supplier").select(key("S", "s_suppkey").alias("key"), F.lit("supplier").alias("kind"), F.lit(None).cast("string").alias("brand"), F.col("s_acctbal").alias("worth"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count("*").alias("lines"))
    return part.unionByName(supplier), lines.select(key("P", "l_partkey").alias("from"), key("S", "l_suppkey").alias("to"), "quantity", "price", "lines")


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts and suppliers, an edge for each pair that has line items."""
    nodes, edges = supply_tables(spark, sf_dir)
    return graph_from_tables(nodes, "key", edges, "from", "to")


def geo(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and suppliers in nations in regions: a tree for each region."""
    region = table(spark, sf_dir, "region").select(key("R", "r_regionkey").alias("key"), F.lit("region").alias("kind"), F.col("r_name").alias("label"), F.lit(None).cast("double").alias("balance"))
    nation = table(spark, sf_dir, "nation").select(key("N", "n_nationkey").alias("key"), F.lit("nation").alias("kind"), F.col("n_name").alias("label"), F.lit(None).cast("double").alias("balance"))
    customer = table(spark, sf_dir, "customer").select(key("C", "c_custkey").alias("key"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("balance"))
    supplier = table(spark, sf_dir, "supplier").select(key("S", "s_suppkey").alias("key"), F.lit("supplier").alias("kind"), F.lit(None).cast("string").alias("label"), F.col("s_acctbal").alias("balance"))
    edges = table(spark, sf_dir, "nation").select(key("N", "n_nationkey").alias("from"), key("R", "n_regionkey").alias("to"))
    edges = edges.unionByName(table(spark, sf_dir, "customer").select(key("C", "c_custkey").alias("from"), key("N", "c_nationkey").alias("to")))
    edges = edges.unionByName(table(spark, sf_dir, "supplier").select(key("S", "s_suppkey").alias("from"), key("N", "s_nationkey").alias("to")))
    return graph_from_tables(region.unionByName(nation).unionByName(customer).unionByName(supplier), "key", edges, "from", "to")


def users(spark: SparkSession, sf_dir: str) -> Graph:
    """Users, an edge for each pair that follow each other in a cell of hour and event type; ``cells`` says how often.

    Events are numbered by cell and time, and each is joined to the next number, so a cell may hold any number of them.
    """
    events = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("hour"), "event_type", "ts", "event_id", key("U", "user_id").alias("user"))
    placed = dense_ids(events, "event_type", "hour", "ts", "event_id", name="place")
    before = placed.select((F.col("place") + 1).alias("next_"), F.col("event_type").alias("type_"), F.col("hour").alias("hour_"), F.col("user").alias("from"))
    met = placed.join(before, (F.col("place") == F.col("next_")) & F.col("event_type").eqNullSafe(F.col("type_")) & F.col("hour").eqNullSafe(F.col("hour_"))).where(F.col("from") != F.col("user"))
    pairs = met.groupBy(F.least("from", "user").alias("from"), F.greatest("from", "user").alias("to")).agg(F.count("*").alias("cells"))
    return graph_from_tables(events.select(F.col("user").alias("key")).distinct(), "key", pairs, "from", "to")


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, x): what each customer spent by order priority; missing without an order."""
    wide = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderpriority", list(PRIORITIES)).agg(F.round(F.sum("o_totalprice"), 2))
    return long_form(table(spark, sf_dir, "customer").select("c_custkey").join(wide, F.col("c_custkey") == F.col("o_custkey"), "left"), "c_custkey", list(PRIORITIES))


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, v): the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
