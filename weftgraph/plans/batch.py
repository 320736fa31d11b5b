"""The batch job as an application: ``spark-submit weftgraph/plans/batch.py PARAMETERS INPUT...``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from weftgraph.operators import transforms
from weftgraph.plans.pipeline import batch_job
from weftgraph.sources import readers

#: What ``type`` of the parameters may name; a delimited file holds pairs in its first two columns.
READERS = {
    "json": readers.read_json_graph,
    "graphml": readers.read_graphml,
    "graph": lambda spark, path: readers.read_graph_parquet(spark, path)[0],
    "pairwise": lambda spark, path: (lambda df: readers.read_pairwise(df, *df.columns[:2]))(readers.read_delimited(spark, path)),
}
#: What ``plugin.name`` may name; any other name leaves the graph as it is read.
TRANSFORMS = {f.__name__: f for f in (transforms.remove_leaves, transforms.remove_branches, transforms.spanning_tree, transforms.edge_reduction, transforms.knn_edges, transforms.percent_nn, transforms.contract_by_attribute, transforms.separate_by_attribute)}


def run(spark: SparkSession, parameter_file: str, inputs: list[str]) -> list[str]:
    """The paths of the saved graphs, one for each input."""
    return batch_job(spark, inputs, parameter_file, READERS, TRANSFORMS)


def main(arguments: list[str]) -> None:
    if len(arguments) < 2:
        raise SystemExit("usage: batch.py PARAMETERS INPUT...")
    spark = SparkSession.builder.appName("weftgraph batch").getOrCreate()
    print("\n".join(run(spark, arguments[0], arguments[1:])))


if __name__ == "__main__":
    main(sys.argv[1:])
