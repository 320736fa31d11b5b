"""Louvain and Markov clustering."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import Graph, dense_ids, segmented_ranks
from weftgraph.operators.components import component_labels
from weftgraph.plans.iterate import counted, cut, gathered


def cluster_sizes(assigned: DataFrame, name: str = "Cluster") -> DataFrame:
    """(id, cluster, size) from (id, community): ``Cluster 1`` is the largest, ties to the larger community id."""
    counts = assigned.groupBy(F.col("community").alias("c_")).agg(F.count("*").alias("size"))
    ranked = dense_ids(counts.select("c_", "size", (-F.col("size")).alias("by_size"), (-F.col("c_")).alias("by_id")), "by_size", "by_id", name="n_")
    return assigned.join(ranked, F.col("community") == F.col("c_")).select("id", F.concat(F.lit(f"{name} "), (F.col("n_") + 1).cast("string")).alias("cluster"), "size")


def resolution(granularity: float) -> float:
    low, high = math.log10(0.5), math.log10(30)
    return 10 ** (low + (1 - granularity) * (high - low))


def _links(graph: Graph, weight: str | None) -> DataFrame:
    """(node, other, w): symmetric weights between different nodes, parallel edges added up."""
    columns = [weight] if weight else []
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    return graph.incidence(*columns).where("node <> other").groupBy("node", "other").agg(F.sum(w).alias("w"))


def _survey(state: DataFrame, links: DataFrame, gamma: float, total: float, nodes: int | None = None) -> DataFrame:
    """(id, community, k, to, gain, stay, inner, mass) for the nodes of ``state`` (id, community, k), written once.

    ``to`` is the community of largest ``gain``, ``stay`` the gain of the own one; ``inner`` is the weight to other
    nodes of the own community and ``mass`` its summed degrees.  ``links`` has a loop for each node that may be alone in
    its community; what loops weigh doesn't count.  If the number of ``nodes`` is given and small, they are read as
    one partition, so if ``links`` is one too, nothing is exchanged; no join is broadcast.
    """
    mass = state.groupBy(F.col("community").alias("m_")).agg(F.sum("k").alias("mass")).hint("merge")
    between = links.select("node", "other", F.when(F.col("node") != F.col("other"), F.col("w")).otherwise(0.0).alias("w"))
    near = between.join(state.select(F.col("id").alias("i_"), F.col("community").alias("c")).hint("merge"), F.col("other") == F.col("i_"))
    options = near.groupBy("node", "c").agg(F.sum("w").alias("w"))
    own = F.col("c") == F.col("community")
    scored = options.join(state.hint("merge"), F.col("node") == F.col("id")).join(mass, F.col("c") == F.col("m_")).withColumn("gain", gamma * F.col("w") - (F.col("mass") - F.when(own, F.col("k")).otherwise(0.0)) * F.col("k") / total)
    of_own = lambda name: F.max(F.when(own, F.col(name)))
    surveyed = cut(scored.groupBy("id", "community", "k").agg(F.max_by("c", F.struct("gain", -F.col("c"))).alias("to"), F.max("gain").alias("gain"), of_own("gain").alias("stay"), of_own("w").alias("inner"), of_own("mass").alias("mass")))
    return surveyed if nodes is None else gathered(surveyed, nodes)


def _objective(surveyed: DataFrame, looped: float, gamma: float, total: float) -> float:
    """Sum over communities of gamma * inner weight - K^2 / (2 W), K the summed degrees; ``looped`` is what nodes hold inside."""
    sums = surveyed.agg(F.sum("inner").alias("inner"), F.sum(F.col("k") * F.col("mass")).alias("squares")).first()
    return gamma * ((sums["inner"] or 0.0) + looped) / 2 - (sums["squares"] or 0.0) / (2 * total)


def _followed(links: DataFrame) -> DataFrame:
    """(i_, c_): each node of ``links`` with its only neighbour, if it has just one, or itself; of two that have only each other, the lesser."""
    around = links.groupBy("node").agg(F.count_if(F.col("node") != F.col("other")).alias("n"), F.max_by("other", (F.col("node") != F.col("other")).cast("int")).alias("other"))
    leaf = F.col("n") == 1
    twins = around.where(leaf).select(F.col("node").alias("t_"), F.lit(True).alias("twin")).hint("merge")
    met = around.join(twins, F.col("other") == F.col("t_"), "left")
    name = F.when(leaf & F.col("twin").isNotNull(), F.least("node", "other")).when(leaf, F.col("other")).otherwise(F.col("node"))
    return met.select(F.col("node").alias("i_"), name.alias("c_"))


def louvain(graph: Graph, granularity: float = 0.5, weight: str | None = None, max_rounds: int = 20, max_levels: int = 10) -> DataFrame:
    """(id, cluster, size): synchronous Louvain; with ``weight`` an edge attribute weighs the edges.

    In a round every node of one half (by a hash of node and round, so that neighbours seldom swap)
    moves to the neighbouring community of largest positive gain ``gamma * w(node, community) - K * k /
    W`` against staying; what a node of a coarser level holds inside says nothing of where it belongs.
    What a round looks up gives the next moves as well as the objective, so a round is one write.
    When the objective rises no more, communities become nodes and it starts again.  A stop at
    ``max_levels`` before that is reported by a warning.
    A node with one neighbour, joined by w > 0, gains ``(gamma - K / W) * w`` by being with it, wherever that is, and K < 2 W.
    So if ``gamma`` is 2 or more and no weight is negative, every best clustering has them together, and they are one node from the start.
    """
    gamma = resolution(granularity)
    loops = graph.nodes.select(F.col("id").alias("node"), F.col("id").alias("other"), F.lit(0.0).alias("w"))
    links, seen = counted(_links(graph, weight).unionByName(loops), least=F.min("w"), total=F.sum("w"))
    weights, nodes = counted(links.groupBy(F.col("node").alias("id")).agg(F.sum("w").alias("k")))
    member = graph.nodes.select("id", F.col("id").alias("community"))  # original node -> node of this level
    total = (seen["total"] or 0.0) / 2
    looped = 0.0

    def lifted(names: DataFrame) -> tuple[DataFrame, DataFrame, dict, DataFrame, float]:
        """Member, weights, their number, links and looped of the level above, given what each node (i_) belongs to (c_)."""
        names = names.hint("merge")
        above, _ = counted(member.join(names, F.col("community") == F.col("i_")).select("id", F.col("c_").alias("community")))
        summed, many = counted(weights.join(names, F.col("id") == F.col("i_")).groupBy(F.col("c_").alias("id")).agg(F.sum("k").alias("k")))
        ends = links.join(names, F.col("node") == F.col("i_")).drop("i_").withColumnRenamed("c_", "a").join(names, F.col("other") == F.col("i_"))
        joined, inside = counted(ends.groupBy(F.col("a").alias("node"), F.col("c_").alias("other")).agg(F.sum("w").alias("w")), looped=F.sum(F.when(F.col("node") == F.col("other"), F.col("w"))))
        return above, summed, many, joined, inside["looped"] or 0.0

    if total and gamma >= 2 and seen["least"] >= 0:
        names, found = counted(_followed(links.where("node = other or w > 0")), moved=F.count_if(F.col("i_") != F.col("c_")))
        if found["moved"]:
            member, weights, nodes, links, looped = lifted(names)
    for _ in range(max_levels if total else 0):
        at = _survey(weights.select("id", F.col("id").alias("community"), "k"), links, gamma, total, nodes["rows"])
        best, still = _objective(at, looped, gamma, total), 0
        start = best
        for number in range(max_rounds):
            moves = F.when((F.col("gain") > F.col("stay") + 1e-12) & (F.pmod(F.xxhash64("id", F.lit(number)), F.lit(2)) == 0), F.col("to")).otherwise(F.col("community"))
            moved = _survey(at.select("id", moves.alias("community"), "k"), links, gamma, total, nodes["rows"])
            value = _objective(moved, looped, gamma, total)
            if value > best + 1e-9:
                at, best, still = moved, value, 0
            else:
                still += 1
                if still == 2:
                    break
        if best <= start + 1e-9:
            break
        member, weights, nodes, links, looped = lifted(at.select(F.col("id").alias("i_"), F.col("community").alias("c_")))
    else:
        if total:
            warnings.warn(f"Louvain stopped at {max_levels} levels while the objective still rose", stacklevel=2)
    return cluster_sizes(member, "Cluster")


def _squared(matrix: DataFrame, wide: bool, inflation: float, prune: float, keep: int) -> DataFrame:
    """(i, j, p): the square of (i, j, p), its entries raised to ``inflation`` and columns normalised, without entries under ``prune``.

    If some column is ``wide`` (over 2 ``keep`` entries), columns j that are sums of one such and little else
    are not written out: of their entries that only the wide column gives, the first ``keep`` are enough, and what
    all of them add to the sum of the column follows from the wide column's own sum.
    """
    right = matrix.select(F.col("i").alias("m"), F.col("j").alias("j2"), F.col("p").alias("p2"))
    products = lambda chosen: matrix.join(chosen.hint("merge"), F.col("j") == F.col("m")).groupBy("i", F.col("j2").alias("j")).agg(F.sum(F.col("p") * F.col("p2")).alias("p"))
    if not wide:
        return _normalised(products(right).withColumn("p", F.pow("p", inflation))).where(F.col("p") >= prune)
    sizes = matrix.groupBy(F.col("j").alias("s_")).agg(F.count("*").alias("size"))
    terms = right.join(sizes, F.col("m") == F.col("s_"))
    widest = terms.groupBy(F.col("j2").alias("of_")).agg(F.max_by(F.struct("m", "p2"), F.struct("size", "m")).alias("widest"), F.max("size").alias("most"), F.sum("size").alias("all"))
    short = (F.col("most") > 2 * keep) & (F.col("all") - F.col("most") <= keep)
    split = cut(widest.select("of_", F.col("widest.m").alias("a_"), F.col("widest.p2").alias("by_"), short.alias("short")))
    plain = right.join(split.where("not short"), F.col("j2") == F.col("of_"), "left_semi")
    written = _normalised(products(plain).withColumn("p", F.pow("p", inflation))).where(F.col("p") >= prune)
    left = split.where("short").drop("short")
    others = products(right.join(left, (F.col("j2") == F.col("of_")) & (F.col("m") != F.col("a_"))).select("m", "j2", "p2"))
    held = matrix.select(F.col("i").alias("i_"), F.col("j").alias("j_"), F.col("p").alias("p_"))
    met = left.join(others, F.col("j") == F.col("of_"), "left").join(held, (F.col("i") == F.col("i_")) & (F.col("a_") == F.col("j_")), "left")
    met = met.withColumn("both", F.struct("i", F.pow(F.col("p") + F.col("by_") * F.coalesce("p_", F.lit(0.0)), F.lit(inflation)).alias("p")))
    by_column = met.groupBy("of_", "a_", "by_").agg(F.collect_list(F.when(F.col("i").isNotNull(), F.col("both"))).alias("own"), F.coalesce(F.sum(F.pow("p_", F.lit(inflation))), F.lit(0.0)).alias("twice"))
    needed = matrix.join(left.select(F.col("a_").alias("n_")).distinct(), F.col("j") == F.col("n_"), "left_semi")
    sums = needed.groupBy(F.col("j").alias("c_")).agg(F.sum(F.pow("p", F.lit(inflation))).alias("whole"))
    first = segmented_ranks(needed.withColumn("down_", -F.col("p")), "j", "down_", "i").where(F.col("place_") <= 2 * keep)
    first = first.groupBy(F.col("j").alias("f_")).agg(F.collect_list(F.struct("i", "p")).alias("first"))
    known = by_column.join(sums, F.col("a_") == F.col("c_")).join(first, F.col("a_") == F.col("f_"))
    known = known.withColumn("sum_", F.aggregate("own", F.lit(0.0), lambda a, x: a + x["p"]) + F.pow("by_", F.lit(inflation)) * F.greatest(F.col("whole") - F.col("twice"), F.lit(0.0)))
    known = known.withColumn("ids_", F.transform("own", lambda x: x["i"])).withColumn("least_", F.col("sum_") * prune)
    alone = F.transform("first", lambda x: F.struct(x["i"].alias("i"), F.pow(F.col("by_") * x["p"], F.lit(inflation)).alias("p")))
    kept = F.concat(F.filter("own", lambda x: x["p"] >= F.col("least_")), F.filter(alone, lambda x: (x["p"] >= F.col("least_")) & ~F.array_contains("ids_", x["i"])))
    shortened = known.select(F.col("of_").alias("j"), "sum_", F.explode(kept).alias("e")).select("e.i", "j", (F.col("e.p") / F.col("sum_")).alias("p"))
    return written.unionByName(shortened)


def _normalised(m: DataFrame) -> DataFrame:
    return m.select("i", "j", (F.col("p") / F.sum("p").over(Window.partitionBy("j"))).alias("p"))


def mcl(graph: Graph, inflation: float = 2.0, prune: float = 1e-4, keep: int = 100, tolerance: float = 1e-4, max_rounds: int = 50) -> DataFrame:
    """(id, cluster, size): Markov clustering on sparse columns (i, j, p).

    Loops of weight 1 are added and columns normalised; a round squares the matrix, raises it to
    ``inflation``, normalises, and drops entries under ``prune`` and beyond the ``keep`` largest of a
    column.  It ends when no entry changes by ``tolerance``; linked rows and columns are a cluster.
    A round is one write, which sees by how much entries change; few entries need no exchange (``counted``).
    A stop at ``max_rounds`` before that is reported by a warning.
    """
    loops = graph.nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("p"))
    matrix, _ = counted(_normalised(_links(graph, None).select(F.col("node").alias("i"), F.col("other").alias("j"), F.col("w").alias("p")).unionByName(loops)))
    wide = not matrix.groupBy("j").count().where(F.col("count") > 2 * keep).isEmpty()
    for _ in range(max_rounds):
        order = Window.partitionBy("j").orderBy(F.desc("p"), "i")
        sharp = _squared(matrix, wide, inflation, prune, keep)
        pruned, wide = _normalised(sharp.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).drop("r")), False  # no column is wide any more
        # entries that go are written too, once, so that the write sees all changes
        old = matrix.select(F.col("i").alias("i_"), F.col("j").alias("j_"), F.col("p").alias("p_")).hint("merge")
        both = pruned.join(old, (F.col("i") == F.col("i_")) & (F.col("j") == F.col("j_")), "full").select(F.coalesce("i", "i_").alias("i"), F.coalesce("j", "j_").alias("j"), "p", "p_")
        both, seen = counted(both, change=F.max(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("p_", F.lit(0.0)))))
        matrix = both.where("p is not null").select("i", "j", "p")
        if seen["change"] is None or seen["change"] < tolerance:
            break
    else:
        warnings.warn(f"Markov clustering stopped after {max_rounds} rounds, before entries changed by less than {tolerance}", stacklevel=2)
    labels = component_labels(matrix.select(F.col("i").alias("src"), F.col("j").alias("dst")))
    assigned = graph.nodes.select("id").join(labels.toDF("v_", "c_"), F.col("id") == F.col("v_"), "left").select("id", F.coalesce("c_", "id").alias("community"))
    return cluster_sizes(assigned, "Cluster")
