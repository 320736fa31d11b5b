"""SimHash near-duplicates through a hierarchical index over Gray-ordered fingerprints.

Fingerprints sorted by Gray rank have neighbours that differ in few bits.  Runs of them are grouped;
a group keeps the bits that all its members share as a mask and a pattern, and groups of groups
again, each node only the bits that its parent does not hold already.  A search walks down from
the root, adds up the differences on the shared bits, and gives up a whole group as soon as they
exceed the bound.

On Spark the distinct fingerprints are cut into at most ``GROUPS`` ranges of Gray rank.  The upper
index over these ranges is bounded and goes to every task; it says which ranges a fingerprint has to
visit.  Each range is indexed in one task and its visitors stream past.  What a task reports is a
spanning forest of the links that it found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators.components import component_labels

from .common import cut, slices, texts

#: Ranges of Gray rank at most, and fingerprints of a range at least (while there are fewer ranges).
GROUPS, GROUP_ROWS = 4096, 1024
FAN_OUT = 4
#: Queries walked together, and open (query, node) pairs at most.
BATCH, FRONTIER = 4096, 1 << 20
SLICE_BYTES = 4 << 20
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Fingerprint of a UTF-8 text: A-Z lowered, words between ASCII white space, shingles of words."""
    from xxhash import xxh64_intdigest

    words = raw.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        hashes = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(first[k : k + (1 << 16)], last[k : k + (1 << 16)])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long.  A text without words has fingerprint zero."""
    source = texts(df, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, source.schema[0].dataType), T.StructField("fp", T.LongType())])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE_BYTES):
            raws = part.column(1).cast(pa.binary() if pa.types.is_string(part.column(1).type) else pa.large_binary()).to_pylist()
            fps = np.array([simhash(raw, shingle) for raw in raws], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=[id_col, "fp"])

    return source.mapInArrow(prints, schema)


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in Gray order, as a long that sorts like the unsigned rank."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(2**63)))


def gray_rank_of(fps: np.ndarray) -> np.ndarray:
    rank = fps.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    """Levels of (mask, pattern) nodes over codes given as shared masks and patterns, in Gray order."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None):
        masks = np.full(len(patterns), 2**64 - 1, dtype=np.uint64) if masks is None else masks
        levels = [(masks, patterns & masks)]
        while len(levels[-1][0]) > 1:
            mask, pattern = levels[-1]
            starts = np.arange(0, len(mask), FAN_OUT)
            first = np.repeat(pattern[starts], np.diff(np.append(starts, len(mask))))
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ first), starts)
            levels.append((shared, pattern[starts] & shared))
        # a node holds only the bits that its parent does not
        self.levels = []
        for depth, (mask, pattern) in enumerate(levels):
            above = levels[depth + 1][0][np.arange(len(mask)) // FAN_OUT] if depth + 1 < len(levels) else np.uint64(0)
            self.levels.append((mask & ~above, pattern))

    def search(self, queries: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, leaf) whose differences on the leaf's mask are at most ``most``."""
        for start in range(0, len(queries), BATCH):
            asked = queries[start : start + BATCH]
            stack = [(len(self.levels) - 1, np.arange(len(asked)), np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=np.uint8))]
            while stack:
                depth, query, node, so_far = stack.pop()
                if len(query) > FRONTIER:
                    half = len(query) // 2
                    stack += [(depth, query[half:], node[half:], so_far[half:]), (depth, query[:half], node[:half], so_far[:half])]
                    continue
                own, pattern = self.levels[depth]
                so_far = so_far + np.bitwise_count((asked[query] ^ pattern[node]) & own[node])
                kept = so_far <= most
                query, node, so_far = query[kept], node[kept], so_far[kept]
                if not len(query):
                    continue
                if depth == 0:
                    yield query + start, node
                    continue
                below = len(self.levels[depth - 1][0])
                child = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                real = child < below
                stack.append((depth - 1, np.repeat(query, FAN_OUT)[real], child[real], np.repeat(so_far, FAN_OUT)[real]))


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex of the given links with the least vertex of its component, loops left out."""
    names, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends[: len(left)], ends[len(left) :]
    label = np.arange(len(names))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(len(names)))
    return names[child], names[label[child]]


def near_links(distinct: DataFrame, most: int = 2) -> DataFrame:
    """(src, dst): links among distinct fingerprints ``fp`` that connect all within ``most`` differing bits."""
    n = distinct.count()
    n_groups = max(1, min(GROUPS, -(-n // GROUP_ROWS)))
    cuts = []
    if n_groups > 1:  # at most GROUPS quantiles
        ranks = distinct.select(gray_rank(F.col("fp")).alias("rank"))
        cuts = ranks.agg(F.percentile_approx("rank", [k / n_groups for k in range(1, n_groups)], 100_000)).first()[0]
    bounds = np.unique(np.array(cuts, dtype=np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            ranks = gray_rank_of(fps.view(np.uint64)) ^ np.uint64(2**63)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, ranks.view(np.int64), side="left").astype(np.int32)), batch.column(0)], names=["range", "fp"])

    placed = cut(distinct.select("fp").mapInArrow(place, "range int, fp long"))
    shared = placed.groupBy("range").agg(F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any")).orderBy("range").collect()  # at most GROUPS rows
    numbers = np.array([r["range"] for r in shared], dtype=np.int32)
    every, some = (np.array([r[k] for r in shared], dtype=np.int64).view(np.uint64) for k in ("all", "any"))
    masks = ~(every ^ some)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = GrayIndex(every, masks)
        for batch in batches:
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for query, group in upper.search(fps, most):
                yield pa.RecordBatch.from_arrays([pa.array(numbers[group]), pa.array(fps[query].view(np.int64))], names=["range", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, members, current = None, [], None
        for batch in batches:
            ranges, visits, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            fps = fps.view(np.uint64)
            edges = np.flatnonzero(np.diff(ranges) | np.diff(visits.astype(np.int8))) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(ranges)]):
                if start == end:
                    continue
                if ranges[start] != current:
                    index, members, current = None, [], ranges[start]
                if not visits[start]:
                    members.append(fps[start:end])
                    continue
                if index is None:
                    codes = np.concatenate(members)
                    codes = codes[np.argsort(gray_rank_of(codes))]
                    index = GrayIndex(codes)
                asked = fps[start:end]
                for query, leaf in index.search(asked, most):
                    smaller = codes[leaf] < asked[query]  # the other way is found in the other's range
                    child, root = forest(asked[query][smaller], codes[leaf][smaller])
                    if len(child):
                        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(root.view(np.int64))], names=["src", "dst"])

    visitors = placed.mapInArrow(route, "range int, fp long")
    both = placed.withColumn("visit", F.lit(0)).unionByName(visitors.withColumn("visit", F.lit(1))).select("range", "visit", "fp")
    return both.repartition(F.col("range")).sortWithinPartitions("range", "visit").mapInArrow(link, "src long, dst long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 2) -> DataFrame:
    """One row per input row: id, ``fp`` (signed long) and ``component_id``, the least id reachable.

    Two rows link when their fingerprints differ in at most ``most`` bits; links chain.  A null or
    empty text has fingerprint zero and links like any other.  Null ids take part but never name a
    component unless it has no other.  Equal fingerprints are one vertex, so groups of copies add
    no links.  An empty table gives no rows.
    """
    prints = cut(fingerprints(df, id_col, text_col, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = component_labels(near_links(distinct, most))
    rooted = distinct.join(roots, F.col("fp") == F.col("id"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    component = rooted.join(named, "root").select(F.col("fp").alias("fp_"), "component_id")
    return prints.join(component, F.col("fp") == F.col("fp_")).select(id_col, "fp", "component_id")

