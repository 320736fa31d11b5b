"""Removal of byte strings that stand in two places, by distributed prefix doubling.

A string of ``length`` bytes that starts anywhere else too, in the same text or another, goes, in all
its places.  Prefix doubling ranks positions by the bytes that follow them: Spark sorts the pairs of
ranks of a position and of one further on, equal pairs get one rank, which then speaks for the two
stretches together, and positions whose pair nobody shares drop out.  Offsets grow until the ranks
speak for ``length`` bytes.

Three things keep the rows few.

* *Anchors*: a window's anchor is the gram of least hash in it, so equal windows have equal anchors.
  Windows whose anchor occurs once are unique and never become rows.  The windows on end that share
  one anchor, with all bytes they cover, are a *piece*; equal pieces are counted and go on once.
* *A grid*: in a piece, only every GRID-th byte, counted from the anchor, is a position.  That is the
  same byte in each equal window, and a window holds ``core`` whole blocks of the grid wherever it
  starts.  Blocks on end that are unique rule out all windows around them; a stretch of ``core`` + 2
  or 3 blocks that repeats settles all windows inside it.
* Only for what is left, at the edges of repeats, single bytes are positions: there the rank of the
  core is sorted together with the bytes to its left and right.

Equal pairs of a task are put together before they are shuffled, so a passage of millions of
documents comes to the task that ranks it as a few long lists.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton_dedup import gram_hashes
from .common import cut, shared_folder, slices, utf8

GRAM = 64
GRID = 16
#: Windows of a text that are looked at together; below 2 ** PLACE_BITS.
CHUNK = 1 << 19
PLACE_BITS = 20
#: Parts that the texts and the pieces of one anchor are dealt into.
PARTS = 16
SLICE_BYTES = 1 << 20
SPANS = "array<struct<start:long,end:long>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


class Shape:
    """What follows from the length: gram, grid, the blocks of a core, and the bits of a place in a piece."""

    def __init__(self, length: int):
        if length < 8:
            raise ValueError("a string has at least 8 bytes")
        self.length = length
        self.gram = max(2, min(GRAM, length // 4))
        self.grid = max(1, min(GRID, length // 8))
        #: whole blocks that any window holds, and how many blocks further the end of a window can reach
        self.core = (length - self.grid + 1) // self.grid
        self.rest = length - self.core * self.grid
        self.beyond = -(-self.rest // self.grid)
        self.bits = (2 * length).bit_length()


def least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values on end: of the tail of one block and the head of the next."""
    n = len(values)
    blocks = np.concatenate([values, np.full(-n % width, TOP)]).reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def anchored(raw: bytes, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, its place, first window, number of windows) of the runs of windows that share an anchor in one place."""
    total = len(raw) - shape.length + 1
    parts = []
    for begin in range(0, total, CHUNK):
        n = min(CHUNK, total - begin)
        code = np.frombuffer(raw, dtype=np.uint8, count=n + shape.length - 1, offset=begin).astype(np.uint64) + np.uint64(1)
        hashes = gram_hashes(code, shape.gram)
        # of equal hashes the first place: it is in the low bits
        packed = hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        place = (least_of_windows(packed, shape.length - shape.gram + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        parts.append((hashes[place[first]].view(np.int64), place[first] + begin, first + begin, np.diff(np.append(first, n))))
    if not parts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(column) for column in zip(*parts))


def covered(n: int, ranges: list[tuple[int, int]] | np.ndarray) -> list[dict[str, int]]:
    """The maximal runs that ranges of [0, n) cover together."""
    if not len(ranges):
        return []
    ranges = np.asarray(ranges, dtype=np.int64)
    order = np.argsort(ranges[:, 0], kind="stable")
    start, end = ranges[order, 0], np.maximum.accumulate(ranges[order, 1])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return [{"start": a, "end": b} for a, b in zip(start[new].tolist(), end[last].tolist())]


def pair_rows(first: np.ndarray, second: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (r1, r2, place, more) of the given positions; positions of one pair are one row, ``more`` holding the others' places."""
    order = np.lexsort((place, second, first))
    first, second, place = first[order], second[order], place[order]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]) if len(place) else np.zeros(0, dtype=bool)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(place))
    more = [place[a + 1 : b].tobytes() if b - a > 1 else None for a, b in zip(starts.tolist(), ends.tolist())]
    yield pa.RecordBatch.from_arrays([pa.array(first[starts]), pa.array(second[starts]), pa.array(place[starts]), pa.array(more, pa.binary())], names=["r1", "r2", "place", "more"])


PAIRS = "r1 long, r2 long, place long, more binary"


def ranked(pairs: DataFrame) -> DataFrame:
    """(place, rank) of the positions whose pair of ranks another position has too; equal pairs have equal ranks.

    Pairs are sorted over all tasks; a task reads its part in order and holds one row back at most.
    """

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = TaskContext.get().partitionId() << 40
        done: tuple[int, int] | None = None  # the pair that rows were last given the rank of
        kept: tuple[int, int, int] | None = None  # a pair seen once so far, and its place
        for batch in batches:
            r1, r2, place = (batch.column(k).to_numpy() for k in range(3))
            more = batch.column(3).to_pylist()
            if not len(place):
                continue
            if kept is not None:
                r1, r2, place, more = np.append(kept[0], r1), np.append(kept[1], r2), np.append(kept[2], place), [None, *more]
            goes_on = done is not None and (int(r1[0]), int(r2[0])) == done
            new = np.concatenate([[not goes_on], (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])])
            ranks = rank + np.cumsum(new)
            rank = int(ranks[-1])
            many = np.array([1 if m is None else 1 + len(m) // 8 for m in more])
            group = ranks - ranks[0]
            total = np.bincount(group, weights=many)
            if goes_on:
                total[0] += 1
            kept = (int(r1[-1]), int(r2[-1]), int(place[-1])) if total[-1] < 2 else None
            done = None if kept is not None else (int(r1[-1]), int(r2[-1]))
            if kept is not None:
                rank -= 1  # the row comes again
            shared = total[group] >= 2
            places = [place[shared]]
            out = [ranks[shared]]
            for k in np.flatnonzero(shared & (many > 1)).tolist():
                others = np.frombuffer(more[k], dtype=np.int64)
                places.append(others)
                out.append(np.full(len(others), ranks[k]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places)), pa.array(np.concatenate(out))], names=["place", "rank"])

    return pairs.repartition("r1", "r2").sortWithinPartitions("r1", "r2").mapInArrow(rerank, "place long, rank long")


def by_piece(rows: DataFrame, bits: int) -> DataFrame:
    """(piece, ats, ranks) from (place, rank); a piece has few positions."""
    held = rows.groupBy(F.shiftright("place", bits).alias("piece")).agg(F.collect_list(F.struct(F.col("place").bitwiseAND((1 << bits) - 1).alias("at"), "rank")).alias("held"))
    return held.select("piece", F.col("held.at").alias("ats"), F.col("held.rank").alias("ranks"))


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, at, rank) of a batch (piece, ats, ranks), sorted by row and at."""
    ats, ranks = batch.column(1), batch.column(2)
    row = np.repeat(np.arange(len(ats)), np.diff(ats.offsets.to_numpy()))
    at, rank = ats.flatten().to_numpy(), ranks.flatten().to_numpy()
    order = np.lexsort((at, row))
    return row[order], at[order], rank[order]


def shifted_pairs(held: DataFrame, before: int, after: int, bits: int) -> DataFrame:
    """For each position ``at`` whose neighbours ``at - before`` and ``at + after`` have a rank: the pair of these."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, rank = flat(batch)
            if not len(row):
                continue
            key = row << bits | at
            wanted = key + before + after
            found = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            met = (key[found] == wanted) & (at + before + after < 1 << bits)
            piece = batch.column(0).to_numpy()[row[met]]
            yield from pair_rows(rank[met], rank[found[met]], piece << bits | (at[met] + before))

    return held.mapInArrow(pairs, PAIRS)


def dealt(anchors: DataFrame, name: str) -> DataFrame:
    """(name, part): each anchor once for each of PARTS, so that what joins it is spread by anchor and part."""
    parts = anchors.select(name, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    return parts.repartition(name, "part")


def repeated_bytes(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``spans`` (removed byte ranges: start, end), ``n_removed``, ``kept_sha256``.

    Every UTF-8 byte in a string of ``length`` bytes that starts in two places or more is removed, in
    all of them, judged on the input as it is; spans are maximal.  A null text is empty; a text under
    ``length`` bytes keeps all.  Ids play no part, so null and repeated ones are fine, and a repeated
    row is another place for its strings.  An empty table gives no rows; other columns are left out.
    Stretches are named by 128 bits of MD5 where they aren't compared as ranks.
    """
    spark = df.sparkSession
    shape = Shape(length)
    bits, grid, core = shape.bits, shape.grid, shape.core
    id_type = df.schema[id_col].dataType
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.xxhash64(F.col("id").cast("string"), "text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE_BYTES):
            n, blobs, kept, anchors, again = [], [], [], [], []
            for raw in utf8(part.column(1)):
                n.append(len(raw))
                blobs.append(hashlib.md5(raw).digest())
                kept.append(hashlib.sha256(raw).hexdigest())
                own, times = np.unique(anchored(raw, shape)[0], return_counts=True)
                anchors.append(own)
                again.append(own[times > 1])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(blobs, pa.binary()), pa.array(kept), pa.array(anchors, longs), pa.array(again, longs)], names=["id", "row", "n_bytes", "blob", "kept", "anchors", "again"])

    sketched = cut(docs.mapInArrow(sketch, f"id {id_type.simpleString()}, row long, n_bytes long, blob binary, kept string, anchors array<long>, again array<long>"))
    # a copy of a whole text is settled here; one of equal texts goes on
    blobs = sketched.where(F.col("n_bytes") >= length).groupBy(F.col("blob").alias("blob_")).agg(F.count("*").alias("copies"), F.min("row").alias("first"))
    chosen = sketched.join(blobs, (F.col("blob") == F.col("blob_")) & (F.col("row") == F.col("first"))).dropDuplicates(["blob"])
    anchors = chosen.select("first", "blob", F.explode("anchors").alias("anchor"))
    again = chosen.select(F.explode("again").alias("anchor"), F.lit(2).alias("n"))
    shared = anchors.select("anchor", F.lit(1).alias("n")).unionByName(again).groupBy(F.col("anchor").alias("shared")).agg(F.sum("n").alias("n")).where("n > 1")
    shared = dealt(shared, "shared")
    wanted = anchors.join(shared, (F.col("anchor") == F.col("shared")) & (F.pmod("first", F.lit(PARTS)) == F.col("part")), "left_semi").groupBy(F.col("first").alias("row_"), "blob").agg(F.collect_list("anchor").alias("wanted"))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, SLICE_BYTES):
            rows = [], [], []
            for raw, blob, held in zip(utf8(part.column(0)), part.column(1).to_pylist(), part.column(2)):
                if hashlib.md5(raw).digest() != blob:
                    continue  # another text of the same 64-bit hash
                anchor, at, start, n = anchored(raw, shape)
                own: dict[bytes, dict] = {}
                for k in np.flatnonzero(np.isin(anchor, held.values.to_numpy())).tolist():
                    piece = raw[start[k] : start[k] + n[k] + length - 1]
                    digest = hashlib.md5(piece).digest()
                    seen = own.get(digest)
                    if seen is None:
                        seen = own[digest] = {"anchor": int(anchor[k]), "digest": digest, "lead": int(at[k] - start[k]), "windows": int(n[k]), "starts": [], "raw": piece}
                    seen["starts"].append(int(start[k]))
                for column, value in zip(rows, (raw, blob, list(own.values()))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary()), pa.array(rows[2], RUNS)], names=["text", "blob", "runs"])

    RUNS = pa.list_(pa.struct([("anchor", pa.int64()), ("digest", pa.binary()), ("lead", pa.int32()), ("windows", pa.int32()), ("starts", pa.list_(pa.int64())), ("raw", pa.binary())]))
    folder = f"{shared_folder(spark)}/repeated-bytes-{uuid.uuid4().hex}"
    shipped = docs.select("row", "text").join(wanted.hint("shuffle_hash"), F.col("row") == F.col("row_")).select("text", "blob", "wanted")
    shipped.mapInArrow(ship, "text binary, blob binary, runs array<struct<anchor:long,digest:binary,lead:int,windows:int,starts:array<long>,raw:binary>>").write.option("compression", "zstd").parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")
    runs = texts.select("blob", F.explode("runs").alias("run")).select("blob", "run.*")
    # equal pieces once; those of a kind of anchor that all pieces of, or none but one, are repeated need no ranks
    kinds = cut(runs.groupBy("digest", "anchor").agg(F.sum(F.size("starts")).alias("times")))
    mixed = kinds.groupBy(F.col("anchor").alias("mixed")).agg(F.count("*").alias("n"), F.min("times").alias("least")).where("n > 1 and least = 1")
    asked = kinds.join(dealt(mixed, "mixed"), (F.col("anchor") == F.col("mixed")) & (F.pmod(F.xxhash64("digest"), F.lit(PARTS)) == F.col("part")), "left_semi").select(F.col("digest").alias("asked"))
    pieces = runs.join(asked, F.col("digest") == F.col("asked"), "left_semi").groupBy("digest").agg(F.first("lead").alias("lead"), F.first("windows").alias("windows"), F.first("raw").alias("raw"))
    pieces.withColumn("piece", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{folder}/pieces")
    pieces = spark.read.parquet(f"{folder}/pieces")

    width = max(1, core // 4)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first ranks: digests of ``width`` blocks at each position of the grid."""
        for batch in batches:
            digests, places = [], []
            for piece, lead, raw in zip(*(c.to_pylist() for c in batch.columns)):
                for at, begin in enumerate(range(lead % grid, len(raw) - width * grid + 1, grid)):
                    digests.append(hashlib.md5(raw[begin : begin + width * grid]).digest())
                    places.append(piece << bits | at)
            both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield from pair_rows(both[:, 0], both[:, 1], np.array(places, dtype=np.int64))

    held = ranked(pieces.select("piece", "lead", "raw").mapInArrow(blocks, PAIRS))
    while width < core:
        step = min(width, core - width)
        held = ranked(shifted_pairs(by_piece(held, bits), 0, step, bits))
        width += step
    held = cut(held)
    # a stretch that holds all windows around a core, and repeats, settles them
    settled = ranked(shifted_pairs(by_piece(held, bits), 1, shape.beyond, bits)).select(F.col("place").alias("settled"))
    marked = cut(held.join(settled, F.col("place") == F.col("settled"), "left").select("place", "rank", F.col("settled").isNotNull().alias("settled")))
    # where a core has windows that aren't settled, all of its places take part
    open_ = marked.where("not settled").select(F.col("rank").alias("open")).distinct()
    edges = marked.join(open_, F.col("rank") == F.col("open"), "left_semi").select("place", "rank")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows as positions: the rank of the core with the bytes beside it."""
        for batch in batches:
            digests, places = [], []
            for piece, lead, windows, raw, ats, ranks in zip(*(c.to_pylist() for c in batch.columns)):
                for at, rank in zip(ats, ranks):
                    begin = lead % grid + at * grid
                    end, name = begin + core * grid, b"%d:" % rank
                    for left in range(grid):
                        window = begin - left
                        if 0 <= window < windows:
                            digests.append(hashlib.md5(name + b"%d:" % left + raw[window:begin] + raw[end : window + length]).digest())
                            places.append(piece << bits | window)
            both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield from pair_rows(both[:, 0], both[:, 1], np.array(places, dtype=np.int64))

    asked_pieces = pieces.select(F.col("piece").alias("piece_"), "lead", "windows", "raw")
    single = ranked(by_piece(edges, bits).join(asked_pieces, F.col("piece") == F.col("piece_")).select("piece", "lead", "windows", "raw", "ats", "ranks").mapInArrow(around, PAIRS))
    low = F.col("lead") % grid + F.col("at") * grid
    whole = marked.where("settled").select(F.shiftright("place", bits).alias("p_"), F.col("place").bitwiseAND((1 << bits) - 1).alias("at")).join(pieces.select("piece", "digest", "lead", "windows"), F.col("p_") == F.col("piece"))
    whole = whole.select("digest", F.greatest(low - (grid - 1), F.lit(0)).cast("long").alias("start"), F.least(low + 1, "windows").cast("long").alias("end"))
    window = F.col("place").bitwiseAND((1 << bits) - 1)
    single = single.select(F.shiftright("place", bits).alias("p_"), window.alias("start"), (window + 1).alias("end")).join(pieces.select("piece", "digest"), F.col("p_") == F.col("piece")).select("digest", "start", "end")
    often = runs.select("digest", "windows").join(kinds.where("times > 1").select(F.col("digest").alias("often")), F.col("digest") == F.col("often"), "left_semi").groupBy("digest").agg(F.max("windows").alias("windows"))
    every = whole.unionByName(single).where("start < end").unionByName(often.select("digest", F.lit(0).cast("long").alias("start"), F.col("windows").cast("long").alias("end")))
    hits = every.groupBy(F.col("digest").alias("hit")).agg(F.collect_list(F.struct("start", "end")).alias("hits"))
    gone = runs.select("blob", "digest", "starts").join(hits, F.col("digest") == F.col("hit")).groupBy(F.col("blob").alias("gone")).agg(F.collect_list(F.struct("starts", "hits")).alias("found"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE_BYTES):
            spans, kept = [], []
            for raw, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                ranges = []
                for one in found:
                    starts = np.array(one["starts"], dtype=np.int64)
                    for hit in covered(length * 2, [(h["start"], h["end"]) for h in one["hits"]]):
                        ranges.append(np.stack([starts + hit["start"], starts + hit["end"] - 1 + length], axis=1))
                own = covered(len(raw), np.concatenate(ranges))
                digest, at = hashlib.sha256(), 0
                for span in own:
                    digest.update(raw[at : span["start"]])
                    at = span["end"]
                digest.update(raw[at:])
                spans.append(own)
                kept.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, SPAN_TYPE), pa.array(kept)], names=["found", "spans", "cleaned"])

    cleaned = texts.select("blob", "text").join(gone.hint("shuffle_hash"), F.col("blob") == F.col("gone")).select("blob", "text", "found").mapInArrow(keep, f"found binary, spans {SPANS}, cleaned string")
    out = sketched.select("id", "n_bytes", "blob", "kept").join(blobs.where("copies > 1").select("blob_"), F.col("blob") == F.col("blob_"), "left")
    out = out.join(cleaned, (F.col("blob") == F.col("found")) & F.col("blob_").isNull(), "left")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    spans = F.when(F.col("blob_").isNotNull(), all_of_it).otherwise(F.coalesce("spans", F.array().cast(SPANS)))
    kept = F.when(F.col("blob_").isNotNull(), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cleaned", "kept"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select(F.col("id").alias(id_col), "n_bytes", spans.alias("spans"), kept.alias("kept_sha256")).withColumn("n_removed", n_removed)
