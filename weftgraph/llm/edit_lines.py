"""Line deduplication, exact and within a bounded edit distance, by segment partition.

A line is cut into more segments than the bound has edits, so if two lines are within it, some
segments have no edit: they stand in the other line too, moved by at most the edits before them.
At first ``bound + 1`` segments leave one such segment.  Every line is indexed by (length, segment,
content) and probes the lengths and the moves that can match.  Lines that meet are verified with a
banded bit-parallel edit distance.

A content that very many lines share makes a long bucket.  The lines of such buckets are cut anew
into more segments, of which all but ``bound`` have to agree.  What still meets in long buckets then
differs only in the segments left out; these are keyed by patterns with one gap an edit, where a gap
stands for one character or none.  All lines that fit a pattern are within the bound, so each needs
to meet the earliest only.  These are more keys for lines that crowd, not another method: the same
pairs are found at any length of the buckets.

Everything but the verified lines travels as hashes and places; texts are fetched once for the
lines to verify and once to write the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FILTER_BITS, cut, long_columns, marked, set_apart, slices

#: Lines of a bucket beyond which it is cut finer, and the number of segments then.
BUCKET = 64
FINE = 16
SLICE_BYTES = 4 << 20
#: Text whose keys are worked out together; it takes about a hundred times as much memory.
KEY_BYTES = 1 << 20
LAST = 2**63 - 1
BASE = 0x9E3779B97F4A7C15
#: A gap in a pattern: no line holds it.
GAP = "\n"


def line_id(line: bytes) -> int:
    return int.from_bytes(hashlib.md5(line).digest()[:8], "big", signed=True)


def allowed(size, edits: int, chars_per_edit: int):
    """Edits between two lines, the shorter of which has ``size`` characters."""
    return np.minimum(edits, size // chars_per_edit)


def moves(left_out: tuple[int, ...], longer: int) -> Iterator[tuple[int, ...]]:
    """How far the parts before, between and after the left-out segments can have moved with as many edits as these, where the other line is ``longer``."""
    bound = len(left_out)
    for between in product(range(-bound, bound + 1), repeat=bound - 1):
        path = (0, *between, longer)
        # between neighbours there is nothing to move
        tied = all(path[k] == path[k - 1] for k in range(1, bound) if left_out[k] == left_out[k - 1] + 1)
        if tied and sum(abs(b - a) for a, b in zip(path, path[1:])) <= bound:
            yield path


class Segments:
    """Keys of lines: their segments but some, hashed, at every place where they can stand in a line within the bound."""

    def __init__(self, edits: int, chars_per_edit: int, fine: bool):
        self.edits, self.chars_per_edit, self.fine = edits, chars_per_edit, fine
        self.power, self.inverse = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) <= n:
            raised = lambda base: np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, base, dtype=np.uint64)]))
            self.power, self.inverse = raised(BASE), raised(pow(BASE, -1, 1 << 64))

    def keys(self, lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool, tuple]]:
        """(lines concerned, their keys, whether they are indexed, (bounds of the segments, left-out segments, moves))."""
        sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        self._powers(len(codes))
        summed = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((codes + np.uint64(1)) * self.power[: len(codes)])])
        starts = np.cumsum(sizes) - sizes

        def content(own: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
            first, last = (starts[own] + np.clip(x, 0, sizes[own]) for x in (first, last))
            return np.where(first < last, (summed[np.maximum(first, last)] - summed[first]) * self.inverse[first], 0)

        for longer in range(self.edits + 1):
            bound = allowed(sizes - longer, self.edits, self.chars_per_edit)
            for edits in range(max(1, longer), self.edits + 1):
                own = np.flatnonzero((bound == edits) & (sizes > longer))
                if not len(own):
                    continue
                n = max(FINE, edits + 2) if self.fine else edits + 1
                length = sizes[own] - longer  # of the indexed line
                at = length[:, None] * np.arange(n + 1) // n
                for number, left_out in enumerate(combinations(range(n), edits)):
                    ends = (-1, *left_out, n)
                    for path in moves(left_out, longer):
                        key = length.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(number)
                        for before, after, moved in zip(ends, ends[1:], path):
                            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                            if before + 1 < after:
                                key = key + content(own, at[:, before + 1] + moved, at[:, after] + moved)
                        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                        yield own, (key ^ (key >> np.uint64(30))).view(np.int64), not any(path), (at, left_out, path)

    def gaps(self, line: str, at: np.ndarray, left_out: tuple[int, ...], path: tuple[int, ...]) -> list[str] | None:
        """What stands in the left-out segments; None if the moves leave no room."""
        ends = [(int(at[k]) + path[j], int(at[k + 1]) + path[j + 1]) for j, k in enumerate(left_out)]
        return [line[a:b] for a, b in ends] if all(0 <= a <= b for a, b in ends) else None


def gapped(text: str, gaps: int) -> set[str]:
    """All patterns with so many gaps that the text fits; a gap stands for one character or none."""
    if not gaps:
        return {text}
    return {text[:k] + GAP + rest for k in range(len(text) + 1) for taken in (0, 1) if k + taken <= len(text) for rest in gapped(text[k + taken :], gaps - 1)}


def patterns(parts: list[str], gaps: int) -> set[tuple[str, ...]]:
    """All ways to spread so many gaps over the parts."""
    if len(parts) == 1:
        return {(p,) for p in gapped(parts[0], gaps)}
    return {(p, *rest) for k in range(gaps + 1) for p in gapped(parts[0], k) for rest in patterns(parts[1:], gaps - k)}


def _alike(a: str, b: str) -> int:
    """Characters that both begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def within(pattern: str, text: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: an automaton's states in the band of 2 * edits + 1 diagonals, as bits."""
    if abs(len(pattern) - len(text)) > edits:
        return False
    start = _alike(pattern, text)
    pattern, text = pattern[start:], text[start:]
    end = _alike(pattern[::-1], text[::-1])
    pattern, text = pattern[: len(pattern) - end], text[: len(text) - end]
    where: dict[str, int] = {}
    for place, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << (place + edits)
    band = (1 << (2 * edits + 1)) - 1
    # bit t after j characters of text: j - edits + t characters of the pattern are matched
    states = [((1 << (d + 1)) - 1) << edits & band for d in range(edits + 1)]
    for j, c in enumerate(text):
        same = where.get(c, 0) >> j & band
        new = [states[0] & same]
        for d in range(1, edits + 1):
            new.append((states[d] & same | states[d - 1] >> 1 | states[d - 1] | new[d - 1] << 1) & band)
        states = new
        if not states[-1]:
            return False
    return bool(states[-1] >> (len(pattern) - len(text) + edits) & 1)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.xxhash64("id", "text"))


def fetch_lines(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, content) of the wanted (line, id, row, pos); only documents that can hold one are shuffled."""
    by_document = cut(wanted.groupBy(F.col("id").alias("id_"), F.col("row").alias("row_")).agg(F.collect_set(F.struct("line", "pos")).alias("wanted")))
    near = marked(rows, by_document.select(F.col("row_").alias("row")), "row").where("may_").drop("may_")
    held = near.join(by_document.hint("shuffle_hash"), (F.col("id") == F.col("id_")) & (F.col("row") == F.col("row_"))).dropDuplicates(["id", "row"])
    return held.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w")).select("w.line", F.expr("lines[w.pos]").alias("content"))


def _bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the keys (a column of longs)."""
    place = F.col(keys.columns[0]).bitwiseAND(F.lit(FILTER_BITS - 1))
    words = keys.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    at, held = long_columns(words)  # at most FILTER_BITS / 64 rows
    bits[at] = held
    return bits


def near_pairs(members: Callable[[np.ndarray | None], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """(pairs that meet in a bucket, rows of the buckets that are too long).

    ``members`` gives the rows (key, line, indexed), or of them at least those with keys in a bitmap.
    Most buckets hold one line or two and are settled by their least and largest line; only the
    rows of larger ones are shuffled for themselves.
    """
    held = members(None).groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.bool_or("indexed").alias("any"), F.count("*").alias("n"))
    live = cut(held.where("low < high and any").select("key", "low", "high", "n"))
    pairs = live.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    more = live.where("n > 2").select(F.col("key").alias("key_"))
    if more.isEmpty():
        return pairs, None
    met = members(_bits(more)).join(more, F.col("key") == F.col("key_"), "left_semi").groupBy("key", "line").agg(F.bool_or("indexed").alias("indexed"))
    met = cut(met)
    sizes = met.groupBy(F.col("key").alias("key_")).agg(F.count("*").alias("n"))
    short = met.join(sizes.where(F.col("n") <= BUCKET), F.col("key") == F.col("key_")).select("key", "line", "indexed")
    long = met.join(sizes.where(F.col("n") > BUCKET), F.col("key") == F.col("key_")).select("key", "line")
    asked, held = short.select("key", F.col("line").alias("x")), short.where("indexed").select(F.col("key").alias("k_"), F.col("line").alias("y"))
    crossed = asked.join(held, (F.col("key") == F.col("k_")) & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.unionByName(crossed).distinct(), long


def removed_lines(rows: DataFrame, min_chars: int, edits: int, chars_per_edit: int) -> DataFrame:
    """The lines to remove: (id, row, pos, near)."""

    def lines_of(part: pa.RecordBatch) -> Iterator[tuple[int, int, str]]:
        for k, text in enumerate(part.column(1).to_pylist()):
            for pos, line in enumerate(text.split("\n")):
                if len(line) >= min_chars and not line.isspace():
                    yield k, pos, line

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE_BYTES):
            at, pos, digests = [], [], []
            for k, p, line in lines_of(part):
                at.append(k)
                pos.append(p)
                digests.append(hashlib.md5(line.encode()).digest())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at), pa.array(pos, pa.int32()), pa.array(digests, pa.binary())], names=["id", "row", "pos", "digest"])

    lines = cut(rows.mapInArrow(places, "id long, row long, pos int, digest binary"))
    here = F.struct("id", "row", "pos")
    first = cut(lines.groupBy(F.col("digest").alias("digest_")).agg(F.min(here).alias("first"), F.count("*").alias("n_")))
    repeated = first.where("n_ > 1").select("digest_", "first")
    exact = lines.join(repeated, F.col("digest") == F.col("digest_")).where(here > F.col("first")).select("id", "row", "pos", F.lit(False).alias("near"))
    if not edits:
        return exact

    def keys(batches: Iterator[pa.RecordBatch], fine: bool, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        segments = Segments(edits, chars_per_edit, fine)
        for part in slices(batches, 1, KEY_BYTES):
            contents = dict(zip(*(c.to_pylist() for c in part.columns))) if fine else {line_id(line.encode()): line for _, _, line in lines_of(part) if len(line) >= chars_per_edit}
            numbers = np.fromiter(contents, dtype=np.int64, count=len(contents))
            for own, key, indexed, _ in segments.keys(list(contents.values())):
                line = numbers[own]
                if bits is not None:
                    at = key & (FILTER_BITS - 1)
                    kept = (bits[at // 64] >> (at % 64)) & 1 == 1
                    key, line = key[kept], line[kept]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(line), pa.array(np.full(len(key), indexed))], names=["key", "line", "indexed"])

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        segments = Segments(edits, chars_per_edit, True)
        for batch in batches:
            for number, content, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                found: set[int] = set()
                for _, key, _, (at, left_out, path) in segments.keys([content]):
                    parts = segments.gaps(content, at[0], left_out, path) if int(key[0]) in wanted else None
                    if parts is not None:
                        found.update(xxh64_intdigest(GAP.join((str(key[0]), *p)).encode("utf-8", "surrogatepass")) - 2**63 for p in patterns(parts, len(left_out)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([number] * len(found), pa.int64())], names=["key", "line"])

    shape = "key long, line long, indexed boolean"
    number = F.conv(F.hex(F.substring("digest_", 1, 8)), 16, -10).cast("long")
    place = first.select(number.alias("line"), "first.id", "first.row", "first.pos")
    pairs, long = near_pairs(lambda bits: rows.mapInArrow(lambda batches: keys(batches, False, bits), shape))
    found = cut(pairs)
    if long is not None and not (long := cut(long)).isEmpty():
        contents = cut(fetch_lines(rows, place.join(long.select(F.col("line").alias("l_")).distinct(), F.col("line") == F.col("l_")).drop("l_")))
        pairs, long = near_pairs(lambda bits: contents.mapInArrow(lambda batches: keys(batches, True, bits), shape))
        found = cut(found.unionByName(pairs))
        if long is not None and not (long := cut(long)).isEmpty():
            wanted = long.groupBy(F.col("line").alias("l_")).agg(F.collect_set("key").alias("wanted"))
            by_pattern = contents.join(wanted, F.col("line") == F.col("l_")).select("line", "content", "wanted").mapInArrow(crowded, "key long, line long")
            order = first.select(number.alias("l_"), "first")
            by_pattern = cut(by_pattern.join(order, F.col("line") == F.col("l_")).select("key", "line", "first"))
            earliest = by_pattern.groupBy(F.col("key").alias("k_")).agg(F.min_by("line", "first").alias("b"))
            stars = by_pattern.join(earliest, (F.col("key") == F.col("k_")) & (F.col("line") != F.col("b")))
            found = found.unionByName(stars.select(F.least("line", "b").alias("a"), F.greatest("line", "b").alias("b")))
    pairs = cut(found.distinct())
    if pairs.isEmpty():
        return exact
    ends = pairs.select(F.col("a").alias("l_")).union(pairs.select(F.col("b").alias("l_"))).distinct()
    contents = cut(fetch_lines(rows, place.join(ends, F.col("line") == F.col("l_")).drop("l_")))
    side = lambda name: contents.select(F.col("line").alias(name), F.col("content").alias(f"{name}_content"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a_content", "b_content")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [(x, y) for x, y in zip(*(c.to_pylist() for c in batch.columns)) if within(x, y, int(allowed(min(len(x), len(y)), edits, chars_per_edit)))]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(pair[k].encode()).digest() for pair in near], pa.binary()) for k in (0, 1)], names=["a", "b"])

    near = both.mapInArrow(verify, "a binary, b binary")
    order = first.select(F.col("digest_").alias("l_"), F.col("first").alias("f_"))
    ordered = near.join(order.select(F.col("l_").alias("a"), F.col("f_").alias("fa")), "a").join(order.select(F.col("l_").alias("b"), F.col("f_").alias("fb")), "b")
    later = ordered.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("later")).distinct()
    # all places of a line that stands near an earlier one; its repeats count as exact already
    close = lines.join(later, F.col("digest") == F.col("later")).select("id", "row", "pos", F.lit(True).alias("near"))
    return exact.unionByName(close).groupBy("id", "row", "pos").agg(F.bool_and("near").alias("near"))


def deduplicate_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, edits: int = 1, chars_per_edit: int = 20) -> DataFrame:
    """``df`` with the repeated lines taken out of its text, plus ``n_lines``, ``n_exact`` and ``n_near``.

    Lines stand between newlines.  In the order of (id, line number), a line of at least
    ``min_chars`` characters goes if an equal line stands before it, or a line close to it first
    stands before it does: within ``edits`` edits, but no more than one for each ``chars_per_edit``
    characters of the shorter line.  Judged on the input, not on what is left.  ``n_exact`` and
    ``n_near`` count the removed lines by reason (equality first).  Empty and blank lines stay.  A
    null text stays null and has no lines.  Null ids come last.  Repeated rows (equal id and text)
    are treated alike, and none removes the other's lines.  All columns and rows of ``df`` stay;
    columns named like a result get ``_in`` appended.

    Lines that crowd in one bucket cost about ``(2 * length of the left-out segments) ** edits`` keys
    each, so bounds above one edit are for tables without large groups of near-equal lines.
    """
    rows = _rows(df, id_col, text_col)
    removed = removed_lines(rows, min_chars, edits, chars_per_edit)
    gone = cut(removed.groupBy(F.col("id").alias("id_"), F.col("row").alias("row_")).agg(F.collect_set(F.struct("pos", "near")).alias("gone_")))
    at, width = df.columns.index(text_col), len(df.columns)
    named = set_apart(df, "n_lines", "n_exact", "n_near")
    schema = T.StructType([*named.schema.fields, *[T.StructField(n, T.LongType()) for n in ("n_lines", "n_exact", "n_near")]])
    own = df.toDF(*[f"c{k}" for k in range(width)])
    own_id = F.coalesce(F.col(f"c{df.columns.index(id_col)}").cast("long"), F.lit(LAST))
    held = own.select("*", own_id.alias("own_id"), F.xxhash64(own_id, F.coalesce(F.col(f"c{at}"), F.lit(""))).alias("own_row"))
    held = marked(held, gone.select(F.col("row_").alias("own_row")), "own_row")
    shuffled = held.where("may_").join(gone.hint("shuffle_hash"), (F.col("own_id") == F.col("id_")) & (F.col("own_row") == F.col("row_")), "left").select(*own.columns, "gone_")
    rest = held.where("not may_").select(*own.columns, F.lit(None).cast(gone.schema["gone_"].dataType).alias("gone_"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at, SLICE_BYTES):
            texts, counts = [], ([], [], [])
            for text, gone in zip(part.column(at).to_pylist(), part.column(width).to_pylist()):
                lines = [] if text is None else text.split("\n")
                counts[0].append(len(lines))
                counts[1].append(sum(not g["near"] for g in gone or ()))
                counts[2].append(sum(g["near"] for g in gone or ()))
                if gone:
                    out = {g["pos"] for g in gone}
                    text = "\n".join(line for k, line in enumerate(lines) if k not in out)
                texts.append(text)
            columns = [pa.array(texts, c.type) if k == at else c for k, c in enumerate(part.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, pa.int64()) for c in counts]], names=schema.names)

    return shuffled.unionByName(rest).mapInArrow(rewrite, schema)
