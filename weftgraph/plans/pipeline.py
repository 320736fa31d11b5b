"""Lists of transforms: run in order, repeated until nothing changes, with results of an unchanged start reused."""

from __future__ import annotations

import json
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from weftgraph.graph import Graph


@dataclass(frozen=True)
class Step:
    """A transform with parameters; ``repeating`` runs it until the graph stays the same."""

    transform: Callable[..., Graph]
    parameters: tuple[tuple[str, Hashable], ...] = ()
    repeating: bool = False

    def __call__(self, graph: Graph) -> Graph:
        return self.transform(graph, **dict(self.parameters))


def step(transform: Callable[..., Graph], repeating: bool = False, **parameters: Hashable) -> Step:
    return Step(transform, tuple(sorted(parameters.items(), key=lambda p: p[0])), repeating)


def until_unchanged(graph: Graph, transform: Callable[[Graph], Graph]) -> Graph:
    """Repeat a transform that only removes or merges until it keeps the numbers of nodes and edges.

    There is no other end: each round before the last makes the graph smaller.  One that makes it
    larger is not such a transform and raises a ValueError.
    """
    size = (graph.nodes.count(), graph.edges.count())
    while True:
        graph = transform(graph).cut()
        now = (graph.nodes.count(), graph.edges.count())
        if now == size:
            return graph
        if now[0] > size[0] or now[1] > size[1]:
            raise ValueError("a repeated transform must not add nodes or edges")
        size = now


@dataclass
class Pipeline:
    """Runs steps from the source graph.  A step that names an unknown attribute is reported and left out;
    any other error ends the run.

    Results are kept by the steps that led to them, so a changed list starts from the first change.
    """

    source: Graph
    kept: dict[tuple[Step, ...], Graph] = field(default_factory=dict)
    problems: list[str] = field(default_factory=list)

    def run(self, steps: list[Step]) -> Graph:
        self.problems = []
        done: tuple[Step, ...] = ()
        graph = self.source
        for one in steps:
            key = (*done, one)
            if key not in self.kept:
                try:
                    self.kept[key] = until_unchanged(graph, one) if one.repeating else one(graph).cut()
                except AnalysisException as problem:
                    if not (problem.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                        raise
                    self.problems.append(f"{one.transform.__name__}: {problem.getMessage()}")
                    continue
            graph, done = self.kept[key], key
        starts = {tuple(steps[:k]) for k in range(len(steps) + 1)} | {done[:k] for k in range(len(done) + 1)}
        self.kept = {k: g for k, g in self.kept.items() if k in starts}
        return graph


def batch_job(spark: SparkSession, inputs: list[str], parameter_file: str, readers: dict[str, Callable[..., Graph]], transforms: dict[str, Callable[..., Graph]] | None = None) -> list[str]:
    """Each input becomes a saved graph, by a JSON file with ``type``, ``plugin.name``, ``plugin.parameters`` and ``destination``.

    ``type`` chooses the reader, ``plugin.name`` a transform of the whole graph, if there is one.
    """
    from weftgraph.sources.writers import write_graph_parquet

    options = json.loads("\n".join(r[0] for r in spark.read.text(parameter_file).collect()))  # a small file
    for key in ("type", "plugin.name"):
        if key not in options:
            raise ValueError(f"{key} is missing")
    out = []
    for path in inputs:
        graph = readers[options["type"]](spark, path)
        transform = (transforms or {}).get(options["plugin.name"])
        if transform:
            graph = transform(graph, **options.get("plugin.parameters", {}))
        name = path.rstrip("/").rpartition("/")[2]
        to = f"{options.get('destination', path.rpartition('/')[0])}/{name}.graph"
        write_graph_parquet(graph, to, {"input": name, **options})
        out.append(to)
    return out
