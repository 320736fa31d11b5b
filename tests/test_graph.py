"""Graph operators on hand-made graphs, with known answers and properties."""

import collections
import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import predicates as P
from weftgraph.graph import Graph, dense_ids, graph_from_tables, unique_name
from weftgraph.operators import cluster, metrics, prep, structure, transforms
from weftgraph.operators import select as selection
from weftgraph.operators.components import component_labels
from weftgraph.plans.pipeline import Pipeline, batch_job, step, until_unchanged
from weftgraph.sources import readers, writers

CLIQUES = [p for s in (0, 5) for p in itertools.combinations(range(s, s + 5), 2)] + [(4, 5)]
SHAPES = {
    "empty": (0, []),
    "isolated": (1, []),
    "loop": (1, [(0, 0)]),
    "parallel": (2, [(0, 1), (1, 0)]),
    "path": (5, [(0, 1), (1, 2), (2, 3), (3, 4)]),
    "star": (6, [(0, k) for k in range(1, 6)]),
    "cycle": (6, [(k, (k + 1) % 6) for k in range(6)]),
    "clique": (5, list(itertools.combinations(range(5), 2))),
    "cliques": (10, CLIQUES),
    "tree": (7, [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6)]),
    "two": (5, [(0, 1), (3, 4)]),
}


def together(*names):
    """One graph of several shapes side by side."""
    n, pairs = 0, []
    for name in names:
        m, own = SHAPES[name]
        pairs += [(a + n, b + n) for a, b in own]
        n += m
    return n, pairs


SHAPES["all"] = together(*SHAPES)
SHAPES["some"] = together("isolated", "parallel", "path", "cycle", "cliques")
SHAPES["ranked"] = together("cycle", "star", "isolated")


def make(spark, shape):
    n, pairs = SHAPES[shape]
    nodes = [(k, f"n{k}", "red" if k % 2 else "blue", None if k == 2 else float(k)) for k in range(n)]
    edges = [(k, a, b, float(k + 1)) for k, (a, b) in enumerate(pairs)]
    return Graph(spark.createDataFrame(nodes, "id long, name string, colour string, x double"), spark.createDataFrame(edges, "edge_id long, src long, dst long, weight double"))


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def components(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("shape", ["empty", "all"])
def test_components_degrees_and_trees(spark, shape):
    n, pairs = SHAPES[shape]
    graph = make(spark, shape)
    wanted = components(n, pairs)
    found = structure.connected_components(graph)
    assert {r["id"]: r["component"] for r in found.nodes.collect()} == dict(enumerate(wanted))
    assert {r["edge_id"]: r["component"] for r in found.edges.collect()} == {k: wanted[a] for k, (a, _) in enumerate(pairs)}
    degree = {r["id"]: (r["degree"], r["in_degree"]) for r in structure.degrees(graph).collect()}
    assert degree == {k: (sum((a == k) + (b == k) for a, b in pairs), sum(b == k for _, b in pairs)) for k in range(n)}
    tree = transforms.spanning_tree(graph)
    assert tree.edges.count() == n - len(set(wanted))
    assert components(n, [(r["src"], r["dst"]) for r in tree.edges.collect()]) == wanted
    core = transforms.remove_branches(graph)
    assert all(r["degree"] >= 2 for r in structure.degrees(core).collect())
    assert structure.check_consistency(graph).count() == 0


def test_components_of_random_graphs(spark):
    draw = random.Random(3)
    for n, m in ((60, 45),):
        pairs = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + [(None, 3)]
        edges = spark.createDataFrame(pairs, "src long, dst long")
        wanted = components(n, pairs[:-1])
        got = {r["id"]: r["component"] for r in component_labels(edges.repartition(3)).collect()}
        assert got == {k: wanted[k] for p in pairs[:-1] for k in p}


def test_contraction(spark):
    graph = make(spark, "path")
    merged = transforms.contract_edges_where(graph, F.col("weight") <= 2)
    assert {r["id"]: (r["head"], r["multiplicity"]) for r in merged.nodes.collect()} == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (3, 1), 4: (4, 1)}
    assert sorted((r["edge_id"], r["src"], r["dst"], r["multiplicity"]) for r in merged.edges.collect()) == [(2, 0, 3, 1), (3, 3, 4, 1)]
    assert ids(structure.expand_selection(merged, spark.createDataFrame([(1,)], "id long"))) == [0, 1, 2]
    assert {(r["node"], r["kind"]) for r in structure.merge_sets(merged).collect()} == {(0, "head"), (1, "tail"), (2, "tail"), (3, "not"), (4, "not")}
    parallel = transforms.contract_edges_where(make(spark, "cycle"), F.col("edge_id").isin(0, 3))
    assert sorted(r["multiplicity"] for r in parallel.edges.collect()) == [1, 1, 1, 1]


def test_filters_treat_missing_as_no_match(spark):
    graph = make(spark, "path")
    assert ids(transforms.remove_nodes_where(graph, P.greater(F.col("x"), 2)).nodes) == [0, 1, 2]
    assert ids(transforms.keep_nodes_where(graph, F.col("x") > 0).nodes) == [1, 3, 4]
    assert ids(transforms.keep_edges_where(graph, P.less(P.source("x"), P.target("x")), ("x",)).edges, "edge_id") == [0, 3]
    assert ids(transforms.separate_by_attribute(graph, "x").edges, "edge_id") == []
    nan = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None)], "id long, x double")
    assert ids(nan.where(P.at_least(F.col("x"), 0.7))) == [2] and ids(nan.where(~P.at_least(F.col("x"), 0.7))) == [1, 3]
    assert ids(nan.where(P.differs(F.col("x"), 5.0))) == [1, 2]


def test_leaves_and_neighbours(spark):
    graph = make(spark, "tree")
    assert ids(transforms.remove_leaves(graph).nodes) == [0, 1, 2]
    assert ids(transforms.remove_leaves(graph, 2).nodes) == [0]
    ranked = transforms.knn_edges(make(spark, "clique"), "weight", 1)
    assert ranked.edges.count() <= 5 and all(r["k-NN Mean Rank"] == 1.0 for r in ranked.edges.where("`k-NN Source Rank` = 1 and `k-NN Target Rank` in (0, 1)").collect())
    thinned = transforms.edge_reduction(make(spark, "cliques"), 10, 2)
    assert ids(thinned.edges, "edge_id") == ids(transforms.edge_reduction(make(spark, "cliques"), 10, 2).edges, "edge_id")
    assert all(r["degree"] >= 1 for r in structure.degrees(thinned).collect())
    assert structure.graph_diff(graph, transforms.remove_leaves(graph)).where("element = 'node' and change = 'removed'").count() == 4


def brandes(n, pairs):
    around = {k: [] for k in range(n)}
    for e, (a, b) in enumerate(pairs):
        if a != b:
            around[a].append((b, e))
            around[b].append((a, e))
    nodes, edges, far = [0.0] * n, [0.0] * len(pairs), []
    for s in range(n):
        dist, sigma, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w, _ in around[v]:
                if w not in dist:
                    dist[w], sigma[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v, e in around[w]:
                if dist[v] == dist[w] - 1:
                    part = sigma[v] / sigma[w] * (1 + delta[w])
                    delta[v] += part
                    edges[e] += part
            if w != s:
                nodes[w] += delta[w]
        far.append(max(dist.values()))
    return nodes, edges, far


def test_betweenness_and_eccentricity(spark):
    graph = make(spark, "some")
    nodes, edges, far = brandes(*SHAPES["some"])
    through, along = metrics.betweenness(graph, batch=12)
    assert {r["id"]: r["betweenness"] for r in through.collect()} == pytest.approx(dict(enumerate(nodes)))
    assert {r["edge_id"]: r["betweenness"] for r in along.collect()} == pytest.approx(dict(enumerate(edges)))
    assert {r["id"]: r["eccentricity"] for r in metrics.eccentricity(graph).collect()} == dict(enumerate(far))


def test_betweenness_of_trees_needs_no_search(spark, monkeypatch):
    """A random tree, a path, a pair, a lone node and a star with a loop; then a cycle with a tail besides, which is searched."""
    draw = random.Random(4)
    pairs = [(k, draw.randrange(k)) for k in range(1, 20)] + [(k, k + 1) for k in range(20, 27)] + [(28, 29)] + [(31, k) for k in range(32, 37)] + [(31, 31)]

    def check(n, pairs):
        graph = Graph(spark.createDataFrame([(k,) for k in range(n)], "id long"), spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "edge_id long, src long, dst long"))
        nodes, edges, _ = brandes(n, pairs)
        through, along = metrics.betweenness(graph)
        assert {r["id"]: r["betweenness"] for r in through.collect()} == pytest.approx(dict(enumerate(nodes)))
        assert {r["edge_id"]: r["betweenness"] for r in along.collect()} == pytest.approx(dict(enumerate(edges)))

    check(42, [*pairs, (37, 38), (38, 39), (39, 40), (40, 37), (40, 41), (37, 38)])

    def fail(*_):
        raise AssertionError("searched")

    monkeypatch.setattr(metrics, "shortest_paths", fail)
    check(37, pairs)


def test_pagerank(spark):
    ranks = {r["id"]: r["pagerank"] for r in metrics.pagerank(make(spark, "ranked"), tolerance=1e-3).collect()}
    # of a star: centre c and leaf l with c = 0.2 / 6 + 0.8 * 5 l and l = 0.2 / 6 + 0.8 c / 5
    c = (0.2 / 6) * (1 + 4) / (1 - 4 * 0.16)
    leaf = 0.2 / 6 + 0.16 * c
    assert ranks == pytest.approx({**dict.fromkeys(range(7), 1.0), **dict.fromkeys(range(7, 12), leaf / c), 12: 1.0}, abs=2e-3)
    assert metrics.pagerank(make(spark, "empty"), max_rounds=5).count() == 0


def test_clusters(spark):
    graph = make(spark, "cliques")
    for found in (cluster.louvain(graph), cluster.mcl(graph)):
        of = {r["id"]: r["cluster"] for r in found.collect()}
        assert len({of[k] for k in range(5)}) == len({of[k] for k in range(5, 10)}) == 1 and of[0] != of[9]
    assert cluster.louvain(make(spark, "empty")).count() == 0
    assert math.isclose(cluster.resolution(1.0), 0.5) and math.isclose(cluster.resolution(0.0), 30)


def louvain_one_by_one(n, edges, gamma):
    """Objective that nodes reach when they move one after another, at all levels."""
    links = collections.defaultdict(lambda: collections.defaultdict(float))
    for a, b in edges:
        links[a][b] += 1
        links[b][a] += 1
    k = {v: sum(links[v].values()) for v in range(n)}
    total, member = sum(k.values()) / 2, {v: v for v in range(n)}
    while True:
        at, mass, moved = {v: v for v in links}, dict(k), False
        while True:
            changed = False
            for v in sorted(links):
                near = collections.defaultdict(float, {at[v]: 0.0})
                for u, w in links[v].items():
                    if u != v:
                        near[at[u]] += w
                mass[at[v]] -= k[v]
                stay = gamma * near[at[v]] - mass[at[v]] * k[v] / total
                gain, to = max((gamma * w - mass[c] * k[v] / total, -c) for c, w in near.items())
                if gain > stay + 1e-9:
                    at[v], changed, moved = -to, True, True
                mass[at[v]] += k[v]
            if not changed:
                break
        member = {v: at[c] for v, c in member.items()}
        if not moved:
            break
        lifted = collections.defaultdict(lambda: collections.defaultdict(float))
        for v in links:
            for u, w in links[v].items():
                lifted[at[v]][at[u]] += w
        links, k = lifted, {c: mass[c] for c in lifted}
    return member


def value_of(member, edges, gamma):
    inner = sum(member[a] == member[b] for a, b in edges)
    mass = collections.Counter()
    for a, b in edges:
        mass[member[a]] += 1
        mass[member[b]] += 1
    return gamma * inner - sum(m * m for m in mass.values()) / (2 * len(edges))


@pytest.mark.parametrize("kind", ["ring", "planted"])
def test_louvain_reaches_the_objective_of_moves_one_by_one(spark, kind):
    draw = random.Random(8)
    if kind == "ring":
        n, edges = 96, [(4 * c + a, 4 * c + b) for c in range(24) for a in range(4) for b in range(a)] + [(4 * c, (4 * c + 5) % 96) for c in range(24)]
    else:
        n, edges = 80, [(a, b) for a in range(80) for b in range(a) if draw.random() < (0.5 if a // 16 == b // 16 else 0.03)]
    nodes = spark.range(n)
    graph = Graph(nodes, spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(edges)], "edge_id long, src long, dst long"))
    gamma = cluster.resolution(0.5)
    found = {r["id"]: r["cluster"] for r in cluster.louvain(graph).collect()}
    assert value_of(found, edges, gamma) >= 0.98 * value_of(louvain_one_by_one(n, edges, gamma), edges, gamma)


def test_text_tables_keep_rows_like_the_header_and_quoted_cells(spark, tmp_path):
    path = tmp_path / "table.txt"
    path.write_text('a b\n1 2\na b\n"x y"\t3\n\n')
    assert sorted(map(tuple, readers.read_delimited(spark, str(path), "txt").collect())) == [("1", "2"), ("a", "b"), ("x y", "3")]
    assert readers.read_delimited(spark, str(path), "txt", header=False).count() == 4


def test_nearest_edges_with_a_clashing_attribute(spark):
    graph = make(spark, "star")
    named = graph.with_edges(graph.edges.withColumn("kept_", F.lit("mine")))
    assert {r["kept_"] for r in transforms.knn_edges(named, "weight", 2).edges.collect()} == {"mine"}


def test_pipeline_reuses_and_reports(spark):
    calls = []

    def drop_leaves(graph):
        calls.append(1)
        return transforms.remove_leaves(graph)

    run = Pipeline(make(spark, "tree"))
    first = [step(drop_leaves), step(transforms.separate_by_attribute, attribute="colour")]
    a = run.run(first)
    run.run([*first, step(transforms.separate_by_attribute, attribute="nothing")])
    assert len(calls) == 1 and len(run.problems) == 1 and ids(a.nodes) == [0, 1, 2]
    assert run.run([step(transforms.remove_leaves, repeating=True)]).nodes.count() == 0
    assert until_unchanged(make(spark, "cycle"), transforms.remove_leaves).nodes.count() == 6


def test_tables_round_trips_and_names(spark, tmp_path):
    graph = make(spark, "path")
    path = str(tmp_path / "g")
    writers.write_graph_parquet(graph, path, {"transforms": ["a"]})
    again, notes = readers.read_graph_parquet(spark, path)
    assert notes == {"transforms": ["a"]} and structure.graph_diff(graph, again).count() == 0
    writers.write_pairwise(graph, str(tmp_path / "p"))
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "p")).collect())
    assert lines[0] == '"n0" "n1" 1.0' and len(lines) == 4
    writers.write_attribute_table(graph.nodes, str(tmp_path / "t"), ["name", "x"], "name")
    back = readers.read_delimited(spark, str(tmp_path / "t"))
    assert back.columns == ["name", "x"] and back.count() == 5
    writers.write_json_elements(graph, str(tmp_path / "j"))
    objects = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert sum(o["kind"] == "edge" for o in objects) == 4 and {o["metadata"]["colour"] for o in objects if o["kind"] == "node"} == {"red", "blue"}
    made = graph_from_tables(spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "k string"), "k", spark.createDataFrame([("a", "b"), ("b", "z"), (None, "a")], "s string, t string"), "s", "t")
    assert [(r["id"], r["name"]) for r in made.nodes.orderBy("id").collect()] == [(0, "a"), (1, "b")] and made.edges.count() == 1
    assert unique_name("x", ["x", "x(1)"]) == "x(2)"
    numbered = dense_ids(spark.range(100).repartition(7).withColumnRenamed("id", "v"), "v")
    assert [r["id"] for r in numbered.orderBy("v").collect()] == list(range(100))


def test_file_readers(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.csv").write_text("a,b,c\n1,2,3\n4,5,6\n")
    (tmp_path / "f" / "b.txt").write_text("a;b\n1;2\n")
    found = {r["file"].rpartition("/")[2]: r["delimiter"] for r in readers.sniff_delimiter(spark, str(tmp_path / "f")).collect()}
    assert found == {"a.csv": ",", "b.txt": ";"}
    (tmp_path / "t.txt").write_text("a  b\tc\n1 2  3\n\n")
    assert [tuple(r) for r in readers.read_delimited(spark, str(tmp_path / "t.txt"), "txt").collect()] == [("1", "2", "3")]
    (tmp_path / "g.json").write_text(json.dumps({"graph": {"nodes": [{"id": "x", "label": "X", "metadata": {"c": 1}}, {"id": "y"}], "edges": [{"source": "x", "target": "y", "metadata": {"w": 2}}]}}))
    graph = readers.read_json_graph(spark, str(tmp_path / "g.json"))
    assert sorted((r["name"], r["c"]) for r in graph.nodes.collect()) == [("X", "1"), ("y", None)] and graph.edges.first()["w"] == "2"
    (tmp_path / "bad.json").write_text(json.dumps({"graphs": [{"nodes": [{"id": "x"}], "edges": [{"source": "x", "target": "q"}]}]}))
    with pytest.raises(ValueError):
        readers.read_json_graph(spark, str(tmp_path / "bad.json"))
    (tmp_path / "g.xml").write_text('<graphml><key id="k" for="node" attr.name="colour"/><key id="w" for="edge" attr.name="weight"/><graph><node id="a"><data key="k">red</data></node><node id="b"><data key="k">blue</data></node><edge source="a" target="b"><data key="w">3</data></edge><edge source="a" target="z"><data key="w">1</data></edge></graph></graphml>')
    graph = readers.read_graphml(spark, str(tmp_path / "g.xml"))
    assert sorted((r["name"], r["colour"]) for r in graph.nodes.collect()) == [("a", "red"), ("b", "blue")] and [r["weight"] for r in graph.edges.collect()] == ["3"]
    (tmp_path / "job.json").write_text(json.dumps({"type": "json", "plugin.name": "leaves", "plugin.parameters": {"limit": 1}, "destination": str(tmp_path / "out")}))
    saved = batch_job(spark, [str(tmp_path / "g.json")], str(tmp_path / "job.json"), {"json": readers.read_json_graph}, {"leaves": transforms.remove_leaves})
    assert readers.read_graph_parquet(spark, saved[0])[0].nodes.count() == 0


def test_selection_and_natural_order(spark):
    graph = make(spark, "star")
    some = graph.nodes.where("id < 2").select("id")
    assert ids(selection.invert(graph, some)) == [2, 3, 4, 5] and ids(selection.find_nodes(graph, "N1")) == [1] and ids(selection.find_nodes(graph, "n1", exact=True)) == [1]
    assert ids(selection.find_nodes(graph, "N1", match_case=True)) == []
    df = spark.createDataFrame([("a10",), ("a9",), ("a009b",), ("b1",), ("a",)], "s string")
    assert [r["s"] for r in selection.natural_sort(df, "s").collect()] == ["a", "a9", "a009b", "a10", "b1"]


def test_size_curve_of_a_hub_is_limited_before_the_exchange(spark, capsys):
    """A hub's edges beyond the last step drop out in every task."""
    star = spark.range(1000).select(F.col("id").alias("edge_id"), F.lit(0).cast("long").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    curve = prep.graph_size_curve_knn(star, 10)
    curve.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
    assert [(r["k"], r["edges"]) for r in curve.orderBy("k").collect()] == [(1, 1000)]
