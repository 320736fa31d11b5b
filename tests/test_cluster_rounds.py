import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import cluster


def links(kind: str) -> list[tuple[int, int]]:
    stars = [(0, k) for k in range(2, 40)] + [(1, k) for k in range(40, 60)] + [(0, 1)]
    return stars + ([(2, 3), (3, 4), (0, 41), (1, 5), (60, 61)] if kind == "linked stars" else [])


@pytest.mark.parametrize("kind", ["stars", "linked stars"])
def test_square_of_wide_columns_equals_numpy_without_all_products(spark, kind):
    pairs, n, keep, prune, inflation = links(kind), 62, 5, 0.02, 2.0
    dense = np.eye(n)
    for a, b in pairs:
        dense[a, b] = dense[b, a] = 1.0
    dense *= np.random.default_rng(3).uniform(0.5, 1.5, dense.shape)
    dense /= dense.sum(axis=0)
    sharp = np.linalg.matrix_power(dense, 2) ** inflation
    sharp /= sharp.sum(axis=0)
    wanted = {}
    for j in range(n):
        first = [i for i in np.lexsort((np.arange(n), -sharp[:, j])) if sharp[i, j] >= prune][:keep]
        wanted.update({(i, j): sharp[i, j] for i in first})
    rows = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    found = cluster._squared(spark.createDataFrame(rows, "i long, j long, p double"), True, inflation, prune, keep).collect()
    kept: dict = {}
    for r in sorted(found, key=lambda r: (r["j"], -r["p"], r["i"])):
        column = kept.setdefault(r["j"], {})
        if len(column) < keep:
            column[(r["i"], r["j"])] = r["p"]
    assert {k: v for column in kept.values() for k, v in column.items()} == pytest.approx(wanted, abs=1e-12)
    if kind == "stars":  # a leaf's column gives at most 2 * keep + 2 entries, not one for each leaf of its hub
        loose = cluster._squared(spark.createDataFrame(rows, "i long, j long, p double"), True, inflation, 0.0, keep)
        assert loose.where(F.col("j") >= 2).groupBy("j").count().agg(F.max("count")).first()[0] <= 2 * keep + 2


def test_a_louvain_trial_is_one_write(spark, monkeypatch):
    """The survey that gives the moves gives the objective too, the same as by its definition."""
    ring = [(k, (k + 1) % 6, 1.0 + k) for k in range(6)]
    both = [(a, b, w) for a, b, w in ring] + [(b, a, w) for a, b, w in ring]
    links_ = spark.createDataFrame(both, "node long, other long, w double")
    degree = {v: sum(w for a, _, w in both if a == v) for v in range(6)}
    community = {v: v // 3 for v in range(6)}
    state = spark.createDataFrame([(v, community[v], degree[v]) for v in range(6)], "id long, community long, k double")
    total, gamma = sum(degree.values()) / 2, 1.7
    writes = []
    monkeypatch.setattr(cluster, "cut", lambda df, cut=cluster.cut: writes.append(df.columns) or cut(df))
    value = cluster._objective(cluster._survey(state, links_, gamma, total), 0.0, gamma, total)
    inner = sum(w for a, b, w in both if community[a] == community[b])
    squares = sum(sum(degree[v] for v in range(6) if community[v] == c) ** 2 for c in (0, 1))
    assert value == pytest.approx(gamma * inner / 2 - squares / (2 * total))
    assert len(writes) == 1
