"""Exact top-k by inner product: a KD-tree on each shard, searched best first.

Each shard's vectors are split at medians into a tree whose nodes carry tight bounding boxes.  The
largest inner product that a box can hold bounds all its vectors, so nodes are visited from the
best bound downwards until the bound falls below the k-th score so far.  Every query is first
searched on one shard; the k-th score found there goes with it to all the others, which give up
boxes that cannot reach it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARD_ROWS = 8192
QUERY_BLOCK = 2048
LEAF_ROWS = 256
#: Products and sums stay exact in doubles below this.
EXACT = 2**53
#: Scores beyond the longs are held at their ends.
LEAST, MOST = -(2**63), 2**63 - 1


class BoxTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order]
        self.nodes: list[tuple[np.ndarray, np.ndarray, int, int]] = []  # low, high, and two children or (-1, row range)
        self.rows: list[np.ndarray] = []
        self.root = self.grow(np.arange(len(ids)))

    def grow(self, rows: np.ndarray) -> int:
        held = self.vectors[rows]
        low, high = held.min(axis=0), held.max(axis=0)
        me = len(self.nodes)
        self.nodes.append((low, high, -1, -1))
        self.rows.append(rows)
        if len(rows) > LEAF_ROWS and (high > low).any():
            axis = int(np.argmax(high - low))
            middle = len(rows) // 2
            parted = rows[np.argpartition(held[:, axis], middle)]
            left, right = self.grow(np.sort(parted[:middle])), self.grow(np.sort(parted[middle:]))
            self.nodes[me], self.rows[me] = (low, high, left, right), rows[:0]
        return me

    def search(self, query: np.ndarray, own: int, k: int, least) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, none below ``least``; ties to the smaller id."""
        best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.vectors.dtype)
        bound = lambda n: min(max(np.maximum(query * self.nodes[n][0], query * self.nodes[n][1]).sum(), LEAST), MOST)
        heap = [(-bound(self.root), self.root)]
        while heap:
            most, node = heapq.heappop(heap)
            if -most < least:
                break
            _, _, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    reach = bound(child)
                    if reach >= least:
                        heapq.heappush(heap, (-reach, child))
                continue
            rows = self.rows[node]
            scores = self.vectors[rows] @ query
            if scores.dtype == object:
                scores = np.minimum(np.maximum(scores, LEAST), MOST)
            keep = (scores >= least) & (self.ids[rows] != own)
            if keep.any():
                ids, best = np.concatenate([best_ids, self.ids[rows][keep]]), np.concatenate([best, scores[keep]])
                top = np.lexsort((ids, -best))[:k]
                best_ids, best = ids[top], best[top]
                if len(best) == k:
                    least = max(least, best[-1])
        return best_ids, best


def _searched(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(candidates) and len(queries):
        vectors, asked = np.array(candidates["v"].tolist(), dtype=np.float64), np.array(queries["v"].tolist(), dtype=np.float64)
        largest = max(1.0, np.abs(vectors).max(initial=0)) * max(1.0, np.abs(asked).max(initial=0)) * vectors.shape[1]
        if largest >= EXACT:
            vectors, asked = (np.array([[int(x) for x in row] for row in held], dtype=object) for held in (vectors.tolist(), asked.tolist()))
        tree = BoxTree(candidates["vec_id"].to_numpy(dtype=np.int64), vectors)
        for own, key, query, least in zip(queries["vec_id"].tolist(), queries["key_"].tolist(), asked, queries["least"].astype(object).tolist()):
            ids, scores = tree.search(query, own, k, -np.inf if least is None or least != least else least)
            out.append(pd.DataFrame({"query_id": own, "key_": key, "vec_id": ids, "score": [int(s) for s in scores]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "key_": [], "vec_id": [], "score": []}).astype("int64")


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """For each query row its k highest integer inner products: query_id, rank, vec_id, score.

    Components become ``floor(scale * x)``, whole numbers of any size; a score beyond the longs
    is given as the nearest long.  Candidates are all rows of the same dimension with
    another id; fewer than k are all returned.  Ties go to the smaller id.  Rows whose id or vector
    is null, or whose vector is empty or holds a null or non-finite component, take no part, nor do
    those that ``scale`` makes infinite.
    Repeated query rows are asked once; repeated candidate rows each count.
    """
    usable = F.col(id_col).isNotNull() & (F.size(F.coalesce(F.col(vector_col), F.array().cast("array<double>"))) > 0)
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    finite = ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(scaled(x)) | (F.abs(scaled(x)) == float("inf")))
    vectors = cut(
        df.where(usable).where(F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: whole(scaled(x))).alias("v"), is_query.alias("asked"))
    ).withColumn("dim", F.size("v"))
    n, n_queries = vectors.agg(F.count("*"), F.count_if("asked")).first()
    n_shards, n_blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_queries // QUERY_BLOCK))
    held = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int"))
    asked = held.where("asked").select("vec_id", "v", "dim", "shard", F.xxhash64("v").alias("key_"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int").alias("block")).dropDuplicates(["vec_id", "key_"])
    candidates = held.select("vec_id", "v", "dim", "shard").toDF("vec_id", "v", "dim", "shard")
    schema = "query_id long, key_ long, vec_id long, score long"

    def search(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _searched(left, right, k)

    first = candidates.groupBy("shard", "dim").cogroup(asked.withColumn("least", F.lit(None).cast("long")).groupBy("shard", "dim")).applyInPandas(search, schema)
    first = cut(first)
    kth = first.groupBy(F.col("query_id").alias("q_"), F.col("key_").alias("k_")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    bounded = asked.join(kth, (F.col("vec_id") == F.col("q_")) & (F.col("key_") == F.col("k_")), "left").drop("q_", "k_")
    others = bounded.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).where("`to` <> shard").withColumn("shard", F.col("to").cast("int")).drop("to")
    blocks = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    rest = blocks.groupBy("shard", "dim", "block").cogroup(others.groupBy("shard", "dim", "block")).applyInPandas(search, schema)
    order = Window.partitionBy("query_id", "key_").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
