"""Benchmark decontamination with suffix arrays over shards of training text.

A task gathers documents into shards of bounded size and maps words to the numbers of the
benchmark's vocabulary (other words match nothing).  The shard's suffix array has all suffixes that
begin with such a word, sorted by the first words, as many as a window has; ranks come from prefix
doubling.  Every benchmark suffix that a window starts with, equal ones once, is looked up by binary
search, which narrows its interval of the array word by word: what is left after a whole window are
its occurrences.  From there each occurrence is followed in the benchmark's own suffix array, again
by binary search, to the longest verbatim match.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, texts, utf8

#: Text of one shard, and benchmark text that goes to the tasks at once.
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
#: A-Z lowered; all ASCII but digits and letters becomes a space.
WORD_BYTES = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def suffix_array(words: np.ndarray, known: int, depth: int) -> np.ndarray:
    """Places of the suffixes that begin with a word above 0, sorted by their first ``depth`` words, or more; words are at most ``known``."""
    places = np.flatnonzero(words)
    if not len(places):
        return places
    bits = max(1, known.bit_length())
    width = min(63 // bits, depth)
    ahead = lambda ranks, n: np.concatenate([ranks[n:], np.zeros(min(n, len(ranks)), dtype=np.int64)])
    key = words.copy()
    for n in range(1, width):
        key = key << bits | ahead(words, n)
    while True:
        order = np.argsort(key[places])
        ranked = key[places[order]]
        step = ranked[1:] != ranked[:-1]
        if width >= depth or step.all():
            return places[order]
        rank = np.zeros(len(words), dtype=np.int64)
        rank[places[order]] = np.cumsum(np.concatenate([[1], step]))
        key = rank << 32 | ahead(rank, width)
        width *= 2


def narrowed(words: np.ndarray, suffixes: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the intervals [low, high) of sorted suffixes, the parts whose word at ``depth`` is the wanted one, by binary search."""
    ends = []
    for right in (False, True):
        a, b = low.copy(), high.copy()
        while len(open_ := np.flatnonzero(a < b)):
            middle = (a[open_] + b[open_]) // 2
            at = suffixes[middle] + depth
            own = np.where(at < len(words), words[np.minimum(at, len(words) - 1)], 0)
            below = own <= wanted[open_] if right else own < wanted[open_]
            a[open_[below]] = middle[below] + 1
            b[open_[~below]] = middle[~below]
        ends.append(a)
    return ends[0], ends[1]


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) for each place of the ranges [low, high)."""
    many = high - low
    which = np.repeat(np.arange(len(low)), many)
    return which, np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + low[which]


class TestSet:
    """The benchmark's words as numbers, its suffix array, and the distinct windows that count as a hit."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        words, owner, size = [], [], []
        for k, (_, raw) in enumerate(items):
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in raw.translate(WORD_BYTES).split()]
            whole = min(window, len(ids))
            words += [*ids, 0]
            owner += [k] * (len(ids) + 1)
            size += [whole if start + whole <= len(ids) else 0 for start in range(len(ids))] + [0]
        self.words, self.owner, sizes = (np.array(x, dtype=np.int64) for x in (words, owner, size))
        self.suffixes = suffix_array(self.words, len(self.numbers), len(words))
        #: first place, words and holders of each distinct window; holders are items, ``holders[held_from[k]:held_from[k + 1]]``
        starts = np.flatnonzero(sizes)
        rows = np.concatenate([self.words, np.zeros(window, dtype=np.int64)])[starts[:, None] + np.arange(window)]
        rows[np.arange(window) >= sizes[starts][:, None]] = 0
        _, first, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        self.first, self.window, self.size = starts[first], window, sizes[starts[first]]
        pairs = np.unique(which.ravel() * max(len(items), 1) + self.owner[starts])
        self.holders = pairs % max(len(items), 1)
        self.held_from = np.searchsorted(pairs // max(len(items), 1), np.arange(len(first) + 1))

    def number(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, where each text starts, all words); texts are kept apart by a zero."""
        runs = []
        for raw in raws:
            words = raw.translate(WORD_BYTES).split()
            runs.append(np.fromiter(map(self.numbers.get, words, repeat(0)), dtype=np.int64, count=len(words)))
        sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        text = np.zeros(int(starts[-1]), dtype=np.int64)
        for start, run in zip(starts.tolist(), runs):
            text[start : start + len(run)] = run
        return sizes, starts, text

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the window, place in the text) of all occurrences of windows."""
        suffixes = suffix_array(text, len(self.numbers), self.window)
        asked = np.arange(len(self.first))
        low, high = np.zeros(len(asked), dtype=np.int64), np.full(len(asked), len(suffixes), dtype=np.int64)
        for depth in range(self.window):
            asked = asked[self.size[asked] > depth]
            low[asked], high[asked] = narrowed(text, suffixes, low[asked], high[asked], self.words[self.first[asked] + depth], depth)
            asked = asked[low[asked] < high[asked]]
        found, at = spread(low, high)
        return found, suffixes[at]

    def longest(self, text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, place in the benchmark) of the longest match that starts at each place of the text."""
        low, high = np.zeros(len(places), dtype=np.int64), np.full(len(places), len(self.suffixes), dtype=np.int64)
        words, going = np.zeros(len(places), dtype=np.int64), np.arange(len(places))
        while len(going):
            depth = int(words[going[0]])
            going = going[places[going] + depth < len(text)]
            wanted = text[places[going] + depth]
            going, wanted = going[wanted > 0], wanted[wanted > 0]
            left, right = narrowed(self.words, self.suffixes, low[going], high[going], wanted, depth)
            some = left < right
            going = going[some]
            low[going], high[going] = left[some], right[some]
            words[going] += 1
        return words, self.suffixes[low] if len(self.suffixes) else low


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of about BLOCK_BYTES, each small enough for driver and tasks."""
    items = texts(benchmark, item_col, text_col).select(F.col(item_col).cast("string").alias("item"), F.encode(text_col, "UTF-8").alias("raw"))
    held = items.agg(F.sum(F.length("raw"))).first()[0] or 0
    n = -(-held // BLOCK_BYTES) or 1
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "raw"), F.lit(n)) == k)
        yield [(row["item"], bytes(row["raw"])) for row in block.collect()]


def benchmark_matches(df: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, ``n_words``, ``hit_spans``, ``items``, ``longest``; then the columns of ``keep``.

    ``hit_spans`` are the word ranges (start, end) inside occurrences of windows of ``window``
    consecutive item words, or of whole items with fewer words; ``items`` the sorted distinct ids of
    the items concerned (null ids are left out, but their windows hit); ``longest`` the longest
    verbatim match (item, start in the document, words) of a window or more.  Null and empty texts
    have no words and items without words no windows.  A benchmark beyond BLOCK_BYTES is taken block by block over rows
    that are written once with a number each; the blocks' results are then put together by that
    number, so equal ids and repeated rows stay rows of their own.  Without it there is no shuffle.
    """
    shape = "n_words long, hit_spans array<struct<start:long,end:long>>, items array<string>, longest struct<item:string,start:long,words:long>"
    source = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text_"), *keep)
    schema = T.StructType([source.schema[0], *T._parse_datatype_string(shape).fields, *source.schema[2:]])
    context = df.sparkSession.sparkContext

    def matched(source: DataFrame, tests, schema: T.StructType) -> DataFrame:
        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = tests.value
            for part in slices(batches, 1, SHARD_BYTES):
                sizes, starts, text = test.number(utf8(part.column(1)))
                found, places = test.occurrences(text)
                cover = np.zeros(len(text) + 1, dtype=np.int64)
                np.add.at(cover, places, 1)
                np.add.at(cover, places + test.size[found], -1)
                doc = np.searchsorted(starts, places, side="right") - 1
                items: list[list] = [[] for _ in sizes]
                longest: list = [None] * len(sizes)
                held = np.unique(doc * max(len(test.first), 1) + found)  # a document's distinct windows
                doc, found = held // max(len(test.first), 1), held % max(len(test.first), 1)
                which, at = spread(test.held_from[found], test.held_from[found + 1])
                pairs = np.unique(doc[which] * max(len(test.items), 1) + test.holders[at])
                for d, o in zip((pairs // max(len(test.items), 1)).tolist(), (pairs % max(len(test.items), 1)).tolist()):
                    items[d].append(test.items[o])
                places = np.unique(places)
                doc = np.searchsorted(starts, places, side="right") - 1
                words, there = test.longest(text, places)
                best = np.lexsort((places, -words, doc))
                best = best[np.unique(doc[best], return_index=True)[1]]
                for d, o, p, w in zip(doc[best].tolist(), test.owner[there[best]].tolist(), (places - starts[doc])[best].tolist(), words[best].tolist()):
                    longest[d] = {"item": test.items[o], "start": p, "words": w}
                hit = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]])
                turns = np.flatnonzero(np.diff(hit))
                spans: list[list] = [[] for _ in sizes]
                docs = np.searchsorted(starts, turns[::2], side="right") - 1
                for d, start, end in zip(docs.tolist(), (turns[::2] - starts[docs]).tolist(), (turns[1::2] - starts[docs]).tolist()):
                    spans[d].append({"start": start, "end": end})
                columns = [part.column(0), pa.array(sizes), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                columns.append(pa.array([sorted({x for x in own if x is not None}) for own in items], pa.list_(pa.string())))
                columns.append(pa.array(longest, pa.struct([("item", pa.string()), ("start", pa.int64()), ("words", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*columns, *part.columns[2:]], names=schema.names)

        return source.mapInArrow(match, schema)

    blocks = _blocks(benchmark, item_col, item_text_col)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return matched(source, context.broadcast(TestSet(first, window)), schema)
    numbered = cut(source.withColumn("row_", F.monotonically_increasing_id()))
    narrow = numbered.select(id_col, "text_", "row_")
    numbered_schema = T.StructType([*schema[:5], narrow.schema["row_"]])
    found = None
    for block in chain([first, second], blocks):
        tests = context.broadcast(TestSet(block, window))
        one = cut(matched(narrow, tests, numbered_schema).drop(id_col))
        tests.destroy()
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("row_").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("hit_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max_by("longest", F.struct("longest.words", -F.col("longest.start"), "longest.item")).alias("longest"),
    )
    joined = F.aggregate(
        "hit_spans",
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    merged = merged.withColumn("hit_spans", joined).withColumnRenamed("row_", "found_")
    return numbered.join(merged, F.col("row_") == F.col("found_")).select(*schema.names)


def n_hit() -> Column:
    """Number of hit words of a row of ``benchmark_matches``."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])


def is_contaminated() -> Column:
    """The contamination rule: some hit, and at least a twentieth of all words hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))
