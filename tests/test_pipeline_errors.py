"""What a pipeline leaves out, what ends it, and what repeated transforms report."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import cluster, transforms
from weftgraph.plans.pipeline import Pipeline, step, until_unchanged


@pytest.fixture
def path(spark):
    nodes = spark.createDataFrame([(k, f"n{k}", "x") for k in range(4)], "id long, name string, colour string")
    return Graph(nodes, spark.createDataFrame([(k, k, k + 1) for k in range(3)], "edge_id long, src long, dst long"))


def mistyped(graph):
    return graph.with_nodes(graph.nodes.where(F.col("id") + F.array(F.lit(1)) > 0))


def test_only_unknown_attributes_are_left_out(path):
    pipeline = Pipeline(path)
    assert pipeline.run([step(transforms.separate_by_attribute, attribute="nothing"), step(transforms.remove_leaves)]).nodes.count() == 2
    assert len(pipeline.problems) == 1 and "nothing" in pipeline.problems[0]
    with pytest.raises(AnalysisException):
        Pipeline(path).run([step(mistyped)])


def test_repeats_end_only_when_nothing_changes(path):
    assert until_unchanged(path, transforms.remove_leaves).nodes.count() == 0
    with pytest.raises(ValueError):
        until_unchanged(path, lambda g: Graph(g.nodes.union(g.nodes), g.edges))


def test_a_stop_at_the_cap_is_reported(path):
    with pytest.warns(UserWarning, match="Markov clustering stopped after 1 rounds"):
        cluster.mcl(path, max_rounds=1)
    with pytest.warns(UserWarning, match="Louvain stopped at 1 levels"):
        cluster.louvain(path, max_levels=1)
