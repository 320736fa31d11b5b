"""Near-duplicates whose word shingles are similar by Jaccard: SimHash links, verified, and what these miss.

Fingerprints of the shingles go through the Gray-ordered index, whose links join most copies.  A
fingerprint says too little of a similarity of 0.8, at which it differs in about ten bits, so each
link is verified, and pairs in different components yet are found with prefix filters.

Shingles of all texts stand in one order, rare ones first.  Two sets that are similar enough share a
shingle among the first few of both, so each set is listed under its first shingles only and nothing
is missed.  How rare a shingle is comes from counts in ``CELLS`` cells; any order gives the same
result, and this one keeps passages that many texts share out of the lists.

Sets are compared in two rounds.  First those that the fingerprints link, and each with one set of
each of its first ``STARS`` lists, which joins large groups at little cost; then all sets of a list
that are not in one component yet meet.
Shingles are named by 64 bits of XXH64, sets by 64 bits of MD5.

Joins merge: what the driver would broadcast for each of them, however small, adds up there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators.components import component_labels

from .common import cut, long_columns, marked, shared_folder, slices, utf8
from .gray_simhash import LOWER, near_links, simhash

#: Cells in which shingles are counted, and lists of a set that take part in the first round.
CELLS = 1 << 16
STARS = 4
#: Bits of the fixed-size filter that spares sets without candidates a shuffle.
FILTER_BITS = 1 << 21
SLICE_BYTES = 4 << 20


def shingles(raw: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text; a text with fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    words = raw.translate(LOWER).split()
    n = len(words) - shingle + 1 if len(words) > shingle else min(1, len(words))
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(words[k : k + shingle])) for k in range(n)), dtype=np.uint64, count=n))


def needed(size: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Shingles that a set of this size must share with any set that is similar enough."""
    over, under = similarity
    return -(-over * size // under)


SETS = "vertex long, size int, row long, hashes array<long>"


def sets_of(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(vertex, size, row, hashes) of (row, text): the shingles of each text, with a name and their number.

    What uses the sets at once does so in the same Python worker: a second one for each task would hold them again.
    """
    for part in slices(batches, 1, SLICE_BYTES):
        found = [shingles(raw, shingle) for raw in utf8(part.column(1))]
        sizes = np.array([len(hashes) for hashes in found], dtype=np.int32)
        vertices = [int.from_bytes(hashlib.md5(hashes.tobytes()).digest()[:8], "little", signed=True) for hashes in found]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(vertices, pa.int64()), pa.array(sizes), part.column(0), held], names=["vertex", "size", "row", "hashes"])


def fetched(docs: DataFrame, place: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(vertex, hashes) for each ``vertex`` of ``wanted``, from the text at its ``place`` (vertex, row); few others are read to the end or shuffled."""
    chosen = cut(wanted.join(place.hint("merge"), "vertex").select(F.col("row").alias("row_"), F.col("vertex").alias("vertex_")))
    at = chosen.select(F.xxhash64("row_").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("p"))
    words = at.groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    at, held = long_columns(words)  # at most FILTER_BITS / 64 rows
    bits[at] = held

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy() & (FILTER_BITS - 1)
            yield batch.filter(pa.array((bits[at // 64] >> (at % 64)) & 1 == 1)).select([0, 1])

    held = docs.select("row", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("row").alias("h")).mapInArrow(lambda batches: sets_of(near(batches), shingle), SETS)
    return cut(held.join(chosen.hint("shuffle_hash"), F.col("row") == F.col("row_")).select("vertex", "hashes"))


def fingerprint_pairs(prints: DataFrame, most: int) -> DataFrame:
    """(src, dst): pairs of vertices whose fingerprints (vertex, fp) are equal or linked, one for each vertex and each link."""
    held = cut(prints.distinct())
    star = cut(held.groupBy("fp").agg(F.min("vertex").alias("star")))
    equal = held.join(star.hint("merge"), "fp").where("vertex <> star").select("vertex", "star")
    side = lambda name: star.select(F.col("fp").alias(name), F.col("star").alias(f"{name}_star")).hint("merge")
    linked = near_links(star.select("fp"), most).join(side("src"), "src").join(side("dst"), "dst").select("src_star", "dst_star")
    pairs = equal.union(linked).toDF("a", "b").where("a <> b")
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def similar_links(docs: DataFrame, place: DataFrame, shingle: int, similarity: tuple[int, int], seeds: DataFrame) -> DataFrame:
    """(src, dst): links among the shingle sets of (row, text) that connect all pairs similar enough.

    ``place`` gives a row for each vertex; ``seeds`` are pairs of vertices to verify first.  Sets are
    worked out from the texts each time, as they are larger than these.
    """
    texts = docs.select("row", F.coalesce("text", F.lit("")).alias("text"))
    over, under = similarity

    def of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        held = batch.column(batch.schema.get_field_index("hashes"))
        return iter(np.split(held.flatten().to_numpy().view(np.uint64), np.cumsum(held.value_lengths().to_numpy())[:-1]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CELLS, dtype=np.int64)
        for batch in sets_of(batches, shingle):
            for hashes in of(batch):
                np.add.at(held, (hashes % np.uint64(CELLS)).astype(np.int64), 1)
        cells = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(held[cells])], names=["cell", "n"])

    counts = np.zeros(CELLS, dtype=np.int64)
    cells, held = long_columns(texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")))  # at most CELLS rows
    counts[cells] = held

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sets_of(batches, shingle):
            keys, places = [], []
            for hashes in of(batch):
                first = np.lexsort((hashes, counts[(hashes % np.uint64(CELLS)).astype(np.int64)]))[: len(hashes) - int(needed(np.int64(len(hashes)), similarity)) + 1]
                keys.append(hashes[first].view(np.int64))
                places.append(np.arange(len(first)))
            owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            if len(owner):
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(places).astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "place", "vertex", "size"])

    lists = texts.mapInArrow(listed, "key long, place int, vertex long, size int")
    same = Window.partitionBy("key")
    star = F.min_by(F.struct("vertex", "size", "place"), F.xxhash64("vertex", "key")).over(same).alias("star")
    met = lists.select("*", F.min("vertex").over(same).alias("low"), F.max("vertex").over(same).alias("high"), star).where("low < high")
    met = cut(met.drop("low", "high").distinct())

    #: both sizes must allow the similarity, and so must what is left of both sets from the first shared shingle on
    fits = lambda n, p, m, q: (under * F.least(n, m) >= over * F.greatest(n, m)) & ((over + under) * F.least(n - p, m - q) >= over * (n + m))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        contents = fetched(docs, place, pairs.select(F.col("src").alias("vertex")).union(pairs.select(F.col("dst").alias("vertex"))).distinct(), shingle)
        side = lambda name: contents.select(F.col("vertex").alias(name), F.col("hashes").alias(f"{name}_hashes")).hint("merge")
        both = pairs.join(side("src"), "src").join(side("dst"), "dst")
        # a pair at a time by built-in functions: Arrow would hold both sets of thousands of pairs, there and in Python
        common = F.size(F.array_intersect("src_hashes", "dst_hashes"))
        return cut(both.where((over + under) * common >= over * (F.size("src_hashes") + F.size("dst_hashes"))).select("src", "dst"))

    ordered = lambda a, b: (F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    stars = met.where((F.col("place") < STARS) & (F.col("vertex") != F.col("star.vertex")) & fits(F.col("size"), F.col("place"), F.col("star.size"), F.col("star.place")))
    found = verified(stars.select(*ordered("vertex", "star.vertex")).unionByName(seeds).distinct())
    labels = component_labels(found)
    known = met.join(labels.hint("merge"), F.col("vertex") == F.col("id"), "left").select("key", "place", "vertex", "size", F.coalesce("component", "vertex").alias("component"))
    open_keys = known.groupBy(F.col("key").alias("key_")).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key_")
    left = cut(known.join(open_keys.hint("merge"), F.col("key") == F.col("key_")).drop("key_"))
    a, b = left.alias("a"), left.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component")) & fits(F.col("a.size"), F.col("a.place"), F.col("b.size"), F.col("b.place")))
    return found.unionByName(verified(pairs.select(*ordered("a.vertex", "b.vertex")).distinct()))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns as ``c0``, ``c1`` ... and ``row``, a number; written once to the shared folder, so that numbers stay."""
    path = f"{shared_folder(df.sparkSession)}/near-duplicates-{uuid.uuid4().hex}"
    df.toDF(*[f"c{k}" for k in range(len(df.columns))]).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def row_groups(rows: DataFrame, id_col: str, text_col: str, shingle: int, similarity: tuple[int, int], most: int) -> DataFrame:
    """(row, id, component, component_id) of the numbered rows."""
    docs = rows.select("row", F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE_BYTES):
            raws = utf8(part.column(1))
            vertices = [int.from_bytes(hashlib.md5(shingles(raw, shingle).tobytes()).digest()[:8], "little", signed=True) for raw in raws]
            fps = np.array([simhash(raw, shingle) for raw in raws], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(vertices, pa.int64()), pa.array(fps)], names=["row", "id", "vertex", "fp"])

    id_type = rows.schema[id_col].dataType.simpleString()
    found = cut(rows.select("row", F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id")).mapInArrow(prints, f"row long, id {id_type}, vertex long, fp long"))
    first = cut(found.groupBy("vertex").agg(F.min("id").alias("first"), F.min("row").alias("row")))
    seeds = fingerprint_pairs(found.select("vertex", "fp"), most)
    roots = component_labels(similar_links(docs, first.select("vertex", "row"), shingle, similarity, seeds)).withColumnRenamed("id", "root_of")
    rooted = first.join(roots.hint("merge"), F.col("vertex") == F.col("root_of"), "left").select("vertex", "first", F.coalesce("component", "vertex").alias("component"))
    named = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    component = rooted.join(named.hint("merge"), "component").select(F.col("vertex").alias("vertex_"), "component_id", "component")
    return found.join(component.hint("merge"), F.col("vertex") == F.col("vertex_")).select("row", "id", "component", "component_id")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (4, 5), most: int = 2) -> DataFrame:
    """One row per input row: id and ``component_id``, the least id reachable.

    Two rows link when the Jaccard similarity of their sets of ``shingle``-word shingles is at least
    ``similarity`` (a fraction); links chain.  A-Z are lowered and words stand between ASCII white
    space.  Texts without words, null ones too, link with each other.  Null ids take part but never
    name a component unless it has no other.  Equal sets, and so repeated rows, are one vertex.  An
    empty table gives no rows.
    """
    found = row_groups(numbered(df.select(id_col, text_col)), "c0", "c1", shingle, similarity, most)
    return found.select(F.col("id").alias(id_col), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (4, 5), most: int = 2) -> DataFrame:
    """``df`` with one row of each group of near-duplicates: that with the least id, null ids last, and of repeated ones any."""
    rows = numbered(df)
    own_id, own_text = (f"c{df.columns.index(c)}" for c in (id_col, text_col))
    turn = F.struct(F.col("id").isNull(), "id", "row")
    grouped = cut(row_groups(rows, own_id, own_text, shingle, similarity, most).select("component", turn.alias("turn")))
    first = grouped.groupBy(F.col("component").alias("c_")).agg(F.min("turn").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = cut(grouped.join(first.hint("merge"), F.col("component") == F.col("c_")).where("turn <> first").select(F.col("turn.row").alias("gone")))
    held = marked(rows, gone.select(F.col("gone").alias("row")), "row")
    checked = held.where("may_").join(gone.hint("shuffle_hash"), F.col("row") == F.col("gone"), "left_anti")
    return held.where("not may_").unionByName(checked).drop("row", "may_").toDF(*df.columns)
