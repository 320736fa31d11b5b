"""PageRank, betweenness and eccentricity as rounds of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators.structure import connected_components, degrees
from weftgraph.plans.iterate import cut


def pagerank(graph: Graph, damping: float = 0.8, tolerance: float = 1e-6, max_rounds: int = 1000, every: int = 5) -> DataFrame:
    """(id, component, pagerank): undirected PageRank, each component scaled to a maximum of 1.

    A round gives every node ``(1 - damping) / size`` of its component plus ``damping`` times what its
    neighbours hand over per edge, parallel edges counted.  That keeps a component's sum at 1, so
    there is nothing to rescale on the way; a node without edges is a component of its own.  A
    component is done when the sum of its changes in a round is at most ``tolerance``, which is
    looked at every few rounds, and only the others go on.
    """
    nodes = connected_components(graph).nodes.select("id", "component")
    sizes = nodes.groupBy(F.col("component").alias("c_")).agg(F.count("*").alias("size"))
    seen = nodes.join(sizes, F.col("component") == F.col("c_")).join(degrees(graph).select(F.col("id").alias("d_"), "degree"), F.col("id") == F.col("d_"))
    all_nodes = cut(seen.select("id", "component", "degree", (1 / F.col("size")).alias("start")))
    # parallel edges count, so a pair of neighbours is one row with their number
    around = cut(graph.incidence().groupBy("node", "other").agg(F.count("*").alias("n")))
    state = all_nodes.where("degree > 0").withColumn("rank", F.col("start"))
    finished = [all_nodes.where("degree = 0").select("id", "component", F.lit(1.0).alias("rank"))]
    for number in range(1, max_rounds + 1):
        share = state.select(F.col("id").alias("o_"), (damping * F.col("rank") / F.col("degree")).alias("share"))
        handed = around.join(share, F.col("other") == F.col("o_")).groupBy(F.col("node").alias("n_")).agg(F.sum(F.col("share") * F.col("n")).alias("in_"))
        moved = state.join(handed, F.col("id") == F.col("n_")).select("id", "component", "degree", "start", F.col("rank").alias("was"), ((1 - damping) * F.col("start") + F.col("in_")).alias("rank"))
        if number % every and number < max_rounds:
            state = moved.drop("was")
            continue
        moved = cut(moved)
        change = moved.groupBy(F.col("component").alias("c_")).agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("change"))
        marked = cut(moved.drop("was").join(change, F.col("component") == F.col("c_")).drop("c_"))
        finished.append(marked.where(F.col("change") <= tolerance).select("id", "component", "rank"))
        state = marked.where(F.col("change") > tolerance).drop("change")
        if state.isEmpty():
            break
    ranks = reduce(DataFrame.unionByName, [*finished, state.select("id", "component", "rank")])
    top = ranks.groupBy(F.col("component").alias("c_")).agg(F.max("rank").alias("top"))
    return ranks.join(top, F.col("component") == F.col("c_")).select("id", "component", (F.col("rank") / F.col("top")).alias("pagerank"))


def shortest_paths(around: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, dist, sigma) for all nodes that each source reaches: hops and number of shortest paths.

    All sources advance together, a level a round; parallel edges count as separate paths.
    """
    frontier = cut(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("dist"), F.lit(1.0).alias("sigma")))
    seen = frontier
    level = 0
    while not frontier.isEmpty():
        level += 1
        reached = around.join(frontier.select("source", F.col("node").alias("from_"), "sigma"), F.col("other") == F.col("from_")).groupBy("source", "node").agg(F.sum("sigma").alias("sigma"))
        known = seen.select(F.col("source").alias("s_"), F.col("node").alias("n_"))
        frontier = cut(reached.join(known, (F.col("source") == F.col("s_")) & (F.col("node") == F.col("n_")), "left_anti").select("source", "node", F.lit(level).alias("dist"), "sigma"))
        seen = cut(seen.unionByName(frontier))
    return seen


def _batches(graph: Graph, sources: DataFrame | None, batch: int):
    """The sources in parts of about ``batch`` nodes, so that sources times nodes stays bounded."""
    chosen = cut((graph.nodes.select("id") if sources is None else sources.select(F.col(sources.columns[0]).alias("id"))).distinct())
    parts = max(1, -(-chosen.count() // batch))
    for k in range(parts):
        yield chosen.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)


def _searched_next(bounds: DataFrame, width: int, rim: bool) -> DataFrame:
    """Of each component with a wanted node that is unsettled: nodes to search from.

    Half are those that are known to be farthest out and weren't searched from, settled or not, since
    the rim bounds the rest best, once there are bounds (``rim``); half are unsettled wanted ones with
    the least lower bounds.
    """
    unsettled = bounds.where("lower < upper and wanted")
    open_ = bounds.join(unsettled.select(F.col("component").alias("c_")).distinct(), F.col("component") == F.col("c_"), "left_semi")
    place = lambda *order: F.row_number().over(Window.partitionBy("component").orderBy(*order))
    # a limit of the rank is applied in every task before the exchange
    far = open_.where("fresh").withColumn("p_", place(F.desc("lower"), F.desc("upper"), F.xxhash64("id"), "id")).where(F.col("p_") <= width)
    near = unsettled.withColumn("p_", place("lower", "upper", F.desc("degree"), "id")).where(F.col("p_") <= width)
    return cut((far.select("id").union(near.select("id")) if rim else near.select("id")).distinct())


def eccentricity(graph: Graph, sources: DataFrame | None = None, batch: int = 2000) -> DataFrame:
    """(id, eccentricity): the most hops to any node of the component; 0 for a node alone.

    A node with one neighbour is one hop further than that neighbour, so only the others have to be
    settled.  A search from s, d hops away, bounds a node's value: at least ``d`` and ``ecc(s) - d``,
    at most ``ecc(s) + d``.  Rounds search from the nodes with the widest bounds of each component
    until all bounds of what is asked for have met, the first from the node of most neighbours.  After
    a few rounds each takes twice as many, up to ``batch`` a component, so that also a graph whose
    bounds rule nothing out is done in few rounds.
    ``sources`` restricts the nodes that are returned; repeated and unknown ids count once or not at all.
    """
    return eccentricity_with_searches(graph, sources, batch)[0]


def eccentricity_with_searches(graph: Graph, sources: DataFrame | None = None, batch: int = 2000) -> tuple[DataFrame, int]:
    """``eccentricity`` and the number of nodes that were searched from."""
    around = cut(graph.incidence().where("node <> other").select("node", "other").distinct())
    spread = around.groupBy(F.col("node").alias("n_")).agg(F.count("*").alias("degree"), F.min("other").alias("only_"))
    nodes = connected_components(graph).nodes.select("id", "component").join(spread, F.col("id") == F.col("n_"), "left").select("id", "component", F.coalesce("degree", F.lit(0)).alias("degree"), "only_")
    sizes = nodes.groupBy(F.col("component").alias("c_")).agg(F.count("*").alias("size"))
    nodes = cut(nodes.join(sizes, F.col("component") == F.col("c_")).drop("c_"))
    asked = nodes if sources is None else nodes.join(sources.select(F.col(sources.columns[0]).alias("w_")), F.col("id") == F.col("w_"), "left_semi")
    hangs = (F.col("degree") == 1) & (F.col("size") > 2)
    # a node that hangs from another is settled by it
    wanted = asked.select(F.when(hangs, F.col("only_")).otherwise(F.col("id")).alias("w_")).distinct()
    start = nodes.join(wanted, F.col("id") == F.col("w_"), "left")
    bounds = cut(start.select("id", "component", "degree", F.col("w_").isNotNull().alias("wanted"), F.lit(True).alias("fresh"), F.when(F.col("size") <= 2, F.col("size") - 1).otherwise(F.lit(1)).cast("long").alias("lower"), (F.col("size") - 1).cast("long").alias("upper")))
    rounds, searched = 0, 0
    while True:
        chosen = _searched_next(bounds, min(2 ** max(rounds - 3, 0), batch), rounds > 0)
        number = chosen.count()
        if not number:
            break
        searched += number
        paths = shortest_paths(around, chosen)
        reach = paths.groupBy(F.col("source").alias("s_")).agg(F.max("dist").cast("long").alias("ecc"))
        seen = paths.join(reach, F.col("source") == F.col("s_")).groupBy(F.col("node").alias("n_")).agg(
            F.max(F.greatest(F.col("dist").cast("long"), F.col("ecc") - F.col("dist"))).alias("low"), F.min(F.col("ecc") + F.col("dist")).alias("high"), F.min("dist").alias("nearest")
        )
        bounds = cut(bounds.join(seen, F.col("id") == F.col("n_"), "left").select("id", "component", "degree", "wanted", (F.col("fresh") & (F.coalesce("nearest", F.lit(1)) > 0)).alias("fresh"), F.greatest("lower", "low").alias("lower"), F.least("upper", "high").alias("upper")))
        rounds += 1
    known = bounds.select(F.col("id").alias("k_"), F.col("lower").alias("ecc"))
    found = asked.join(known, F.when(hangs, F.col("only_")).otherwise(F.col("id")) == F.col("k_"))
    return found.select("id", (F.col("ecc") + F.when(hangs, 1).otherwise(0)).cast("long").alias("eccentricity")), searched


def betweenness(graph: Graph, sources: DataFrame | None = None, batch: int = 2000) -> tuple[DataFrame, DataFrame]:
    """((id, betweenness), (edge_id, betweenness)): shortest paths through nodes and edges, from every source.

    Each unordered pair counts twice and nothing is normalised.  Parallel edges are separate paths,
    each with its own share; loops carry none.  ``sources`` restricts the starting nodes.  From all
    nodes, components that are trees follow from the sizes of their branches (``_branches``); only
    the others are searched.
    """
    if sources is not None:
        return _searched_betweenness(graph, sources, batch)
    marked = connected_components(Graph(graph.nodes.select("id"), graph.edges.select("edge_id", "src", "dst"))).cut()
    links = marked.edges.where("src <> dst")
    sizes = marked.nodes.groupBy(F.col("component").alias("c_")).agg(F.count("*").alias("size"))
    held = links.groupBy(F.col("component").alias("l_")).agg(F.count("*").alias("links"))
    trees = cut(sizes.join(held, F.col("c_") == F.col("l_"), "left").where(F.coalesce("links", F.lit(0)) == F.col("size") - 1).select("c_", "size"))
    in_tree = F.col("component") == F.col("c_")
    branches = _branches(marked.nodes.join(trees, in_tree, "left_semi").select("id"), links.join(trees, in_tree, "left_semi").select("edge_id", "src", "dst"))
    sized = cut(branches.join(marked.nodes, F.col("v") == F.col("id")).join(trees, in_tree).select("edge_id", "v", "u", "part", "size"))
    ends = sized.select("size", F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("part").alias("far")), F.struct(F.col("v").alias("id"), (F.col("size") - F.col("part")).alias("far")))).alias("end"))
    number = lambda c: F.col(c).cast("double")
    through = ends.groupBy(F.col("end.id").alias("k_")).agg((F.max((number("size") - 1) * (number("size") - 1)) - F.sum(number("end.far") * number("end.far"))).alias("f_"))
    along = sized.select(F.col("edge_id").alias("k_"), (2 * number("part") * (number("size") - number("part"))).alias("f_"))
    rest = Graph(marked.nodes.join(trees, in_tree, "left_anti").select("id"), marked.edges.join(trees, in_tree, "left_anti").select("edge_id", "src", "dst"))
    if not rest.nodes.isEmpty():
        searched = _searched_betweenness(rest, None, batch)
        through, along = through.union(searched[0]), along.union(searched[1])
    zero = F.coalesce("f_", F.lit(0.0)).alias("betweenness")
    return graph.nodes.join(through, F.col("id") == F.col("k_"), "left").select("id", zero), graph.edges.join(along, F.col("edge_id") == F.col("k_"), "left").select("edge_id", zero)


def _branches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, v, u, part) for every edge of a forest: the ``part`` nodes on the side of ``v``, its own included.

    Each round rakes all leaves, whose nodes are then counted by what they hung from; two nodes that
    are left alone with each other hang from the smaller.
    """
    weights = cut(nodes.select("id", F.lit(1).cast("long").alias("w")))
    raked = None
    while True:
        ends = edges.select("edge_id", F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("u")), F.struct(F.col("dst").alias("v"), F.col("src").alias("u")))).alias("end"))
        leaves = ends.groupBy("end.v").agg(F.count("*").alias("n"), F.max("edge_id").alias("edge_id"), F.max("end.u").alias("u")).where("n = 1")
        leaves = leaves.groupBy("edge_id").agg(F.max(F.struct("v", "u")).alias("leaf")).select("edge_id", "leaf.v", "leaf.u")
        now = cut(leaves.join(weights, F.col("v") == F.col("id")).select("edge_id", "v", "u", F.col("w").alias("part")))
        raked = now if raked is None else raked.unionByName(now)
        if now.isEmpty():
            return raked
        more = now.groupBy(F.col("u").alias("u_")).agg(F.sum("part").alias("more"))
        open_ = weights.join(now.select(F.col("v").alias("v_")), F.col("id") == F.col("v_"), "left_anti")
        weights = cut(open_.join(more, F.col("id") == F.col("u_"), "left").select("id", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")))
        edges = cut(edges.join(now.select(F.col("edge_id").alias("e_")), F.col("edge_id") == F.col("e_"), "left_anti"))


def _searched_betweenness(graph: Graph, sources: DataFrame | None, batch: int) -> tuple[DataFrame, DataFrame]:
    """``betweenness`` by searches from every source."""
    around = cut(graph.incidence().where("node <> other").select("edge_id", "node", "other"))
    node_parts, edge_parts = [], []
    for part in _batches(graph, sources, batch):
        paths = shortest_paths(around.select("node", "other"), part)
        ahead = paths.select(F.col("source").alias("s_"), F.col("node").alias("w"), F.col("dist").alias("dw"), F.col("sigma").alias("sw"))
        # every step (v, w) by an edge to the level behind
        steps = cut(paths.join(around.select("edge_id", F.col("other").alias("o_"), F.col("node").alias("t_")), F.col("node") == F.col("o_")).join(ahead, (F.col("source") == F.col("s_")) & (F.col("t_") == F.col("w")) & (F.col("dw") == F.col("dist") + 1)).select("source", F.col("node").alias("v"), "w", "dw", (F.col("sigma") / F.col("sw")).alias("part"), "edge_id"))
        deepest = steps.agg(F.max("dw")).first()[0] or 0
        carried, flows = None, []
        for level in range(deepest, 0, -1):
            here = steps.where(F.col("dw") == level)
            flow = here.withColumn("flow", F.col("part")) if carried is None else here.join(carried, (F.col("source") == F.col("s2_")) & (F.col("w") == F.col("n2_")), "left").withColumn("flow", F.col("part") * (1 + F.coalesce("delta", F.lit(0.0)))).drop("s2_", "n2_", "delta")
            flow = cut(flow.select("source", "v", "edge_id", "flow"))
            flows.append(flow)
            carried = flow.groupBy(F.col("source").alias("s2_"), F.col("v").alias("n2_")).agg(F.sum("flow").alias("delta"))
        if flows:
            every = reduce(DataFrame.unionByName, flows)
            node_parts.append(cut(every.where("v <> source").groupBy("v").agg(F.sum("flow").alias("flow"))))
            edge_parts.append(cut(every.groupBy("edge_id").agg(F.sum("flow").alias("flow"))))
    if not node_parts:
        return graph.nodes.select("id", F.lit(0.0).alias("betweenness")), graph.edges.select("edge_id", F.lit(0.0).alias("betweenness"))
    add = lambda parts, key: reduce(DataFrame.unionByName, parts).groupBy(F.col(key).alias("k_")).agg(F.sum("flow").alias("f_"))
    zero = F.coalesce("f_", F.lit(0.0)).alias("betweenness")
    return graph.nodes.join(add(node_parts, "v"), F.col("id") == F.col("k_"), "left").select("id", zero), graph.edges.join(add(edge_parts, "edge_id"), F.col("edge_id") == F.col("k_"), "left").select("edge_id", zero)
