"""The attributed graph: two DataFrames, nodes by ``id`` and edges by ``edge_id``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.iterate import cut


@dataclass(frozen=True)
class Graph:
    """``nodes(id, name, ...)`` and ``edges(edge_id, src, dst, ...)``.

    A multigraph: several edges may join a pair, and loops are allowed, so ``edge_id`` is the key.
    Direction is kept, but the operators walk edges both ways.  A missing attribute is NULL.
    """

    nodes: DataFrame
    edges: DataFrame

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return Graph(nodes, self.edges)

    def with_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.nodes, edges)

    def cut(self) -> Graph:
        return Graph(cut(self.nodes), cut(self.edges))

    def incidence(self, *columns: str) -> DataFrame:
        """(edge_id, node, other, side): every edge seen from its target and from its source; a loop gives two rows."""
        ends = F.array(
            F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("side")),
            F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("side")),
        )
        return self.edges.select("edge_id", *columns, F.explode(ends).alias("end")).select("edge_id", "end.node", "end.other", "end.side", *columns)


#: ``monotonically_increasing_id`` numbers the rows of a task by this many low bits; the others number the task.
_ROW_BITS = 33


def _ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` written once in the given order, over tasks and inside them, with ``range_`` and ``at_``, the place in the range."""
    written = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seen_", F.monotonically_increasing_id()))
    return written.withColumn("range_", F.shiftright("seen_", _ROW_BITS)).withColumn("at_", F.col("seen_").bitwiseAND((1 << _ROW_BITS) - 1)).drop("seen_")


def dense_ids(df: DataFrame, *order: str | Column, name: str = "id") -> DataFrame:
    """``df`` numbered from 0 in the order of the given columns; rows alike in all of them are numbered in any order.

    Rows are ranged over the cluster by these columns and written once; the ranges' sizes give the
    offsets, one row a range.  No task sees more than its range, and the result needs no further write.
    """
    ranged = _ranged(df, *order)
    sizes = ranged.groupBy("range_").agg(F.count("*").alias("n_"))
    before = sizes.select(F.col("range_").alias("r_"), (F.sum("n_").over(Window.orderBy("range_")) - F.col("n_")).alias("before_"))
    return ranged.join(F.broadcast(before), F.col("range_") == F.col("r_")).select((F.col("at_") + F.col("before_")).cast("long").alias(name), *df.columns)


def segmented_ranks(df: DataFrame, by: str, *order: str | Column, place: str = "place_", size: str = "size_") -> DataFrame:
    """``df`` with each row's place (from 1) among the rows of its ``by`` in the given order, and how many these are.

    Rows are ranged over the cluster by ``by`` and the order, so one value's rows, however many, are
    dealt over as many ranges as they fill.  A range counts the rows of each value; what the ranges
    before hold of a value is the offset of its rows here.  Null is a value like any other.
    """
    ranged = _ranged(df, by, *order)
    runs = ranged.groupBy(F.col("range_").alias("r_"), F.col(by).alias("by_")).agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    same = Window.partitionBy("by_")  # a row for each range that holds the value
    runs = runs.select("r_", "by_", "first_", (F.sum("n_").over(same.orderBy("r_")) - F.col("n_")).alias("before_"), F.sum("n_").over(same).alias("all_"))
    joined = ranged.join(runs, (F.col("range_") == F.col("r_")) & F.col(by).eqNullSafe(F.col("by_")))
    return joined.select(*df.columns, (F.col("at_") - F.col("first_") + F.col("before_") + 1).alias(place), F.col("all_").alias(size))


def graph_from_tables(node_table: DataFrame, key: str, edge_table: DataFrame, source: str, target: str) -> Graph:
    """A graph of any two tables: nodes by their key column, edges by two columns that hold keys.

    Nodes are numbered by sorted key.  Null keys are no nodes; of rows with one key the first by all
    columns counts.  Edges with an end that is no node are dropped; ``edge_id`` follows (src, dst) and
    then the other columns.
    """
    rest = [c for c in node_table.columns if c != key]
    firsts = node_table.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("name")).agg(F.min(F.struct(*rest)).alias("rest_")).select("name", "rest_.*") if rest else node_table.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("name")).distinct()
    nodes = dense_ids(firsts, "name")
    ids = nodes.select("id", "name")
    attributes = [c for c in edge_table.columns if c not in (source, target)]
    ends = edge_table.select(F.col(source).cast("string").alias("source_"), F.col(target).cast("string").alias("target_"), *attributes)
    joined = ends.join(ids.toDF("src", "s_"), F.col("source_") == F.col("s_")).join(ids.toDF("dst", "t_"), F.col("target_") == F.col("t_")).select("src", "dst", *attributes)
    return Graph(nodes, dense_ids(joined, "src", "dst", *attributes, name="edge_id"))


def unique_name(name: str, taken: list[str]) -> str:
    """``name``, or ``name(1)``, ``name(2)`` ... if it is taken."""
    if name not in taken:
        return name
    number = 1
    while f"{name}({number})" in taken:
        number += 1
    return f"{name}({number})"
