"""Removal of passages that repeat an earlier document, found with suffix automata.

A window of ``window`` words is a repeat if the same words start somewhere in a document with a
smaller id.  Reference text is dealt into shards, each small enough for one suffix automaton, and
documents stream past the shard that can hold their matches: in order of id, every passage first
runs through the automaton of what came before it, which gives for each word the length of the
longest match that ends there, and is then added.

Where the reference is a table of its own, its shards' automata are broadcast one after another and
all documents stream past each (``matching_spans``): work is documents times shards.  For a corpus
against itself that is quadratic, and no task can hold the corpus, so there shards are not sent to
all tasks; passages are sent to their shard (``repeated_passages``).  A window's *anchor* is the least hash among its runs of ``GRAM``
words, so equal windows have equal anchors.  Only passages around anchors that occur in two
different documents are shipped, equal passages once.  An anchor with more than ``GROUP_RUNS``
different passages would make one task long: there, windows are compared one by one by their
digests, with an aggregation that is spread over all tasks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, shared_folder, slices, utf8

GRAM = 20
GROUP_RUNS = 4096
CACHE_WORDS = 200_000
SLICE_BYTES = 4 << 20
BASE = 0x9E3779B97F4A7C15


class WordCodes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= CACHE_WORDS:
            self.clear()
        code = self[word] = xxh64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


@lru_cache(maxsize=1)
def codes() -> WordCodes:
    return WordCodes()


def gram_hashes(code: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` words on end: polynomials put together by doubling, then mixed."""
    power = lambda n: np.uint64(pow(BASE, n, 1 << 64))
    whole, held, part, width = None, 0, code, 1
    while True:
        if k & width:
            if whole is None:
                whole, held = part, width
            else:
                n = len(part) - held
                whole, held = whole[:n] * power(width) + part[held:], held + width
        if width * 2 > k:
            break
        part = part[:-width] * power(width) + part[width:]
        width *= 2
    mixed = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def anchored_runs(code: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of the runs of windows that share an anchor."""
    grams = gram_hashes(code, GRAM)
    at = np.lib.stride_tricks.sliding_window_view(grams, window - GRAM + 1).argmin(axis=1) + np.arange(len(code) - window + 1)
    anchor = grams[at].view(np.int64)
    # periodic text has one anchor at many places, and is one run
    starts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    return anchor[starts], starts, np.diff(np.append(starts, len(at)))


class Automaton:
    """A suffix automaton over sequences of word codes, grown one sequence at a time."""

    def __init__(self):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def matches(self, passage: list[int], window: int) -> np.ndarray:
        """Which windows of the passage are in the automaton, by the length of the longest match that ends at each word."""
        step, link, length = self.step, self.link, self.length
        state, matched = 0, 0
        ends = np.zeros(len(passage), dtype=bool)
        for k, c in enumerate(passage):
            while state and c not in step[state]:
                state = link[state]
                matched = length[state]
            if c in step[state]:
                state = step[state][c]
                matched += 1
                if matched >= window:
                    ends[k] = True
            else:
                matched = 0
        return ends[window - 1 :]

    def _split(self, last: int, c: int, q: int) -> int:
        """A copy of state ``q`` for the shorter of its sequences, which now also end elsewhere."""
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[last] + 1)
        link[q] = copy
        while last >= 0 and step[last].get(c) == q:
            step[last][c] = copy
            last = link[last]
        return copy

    def add(self, passage: list[int]) -> None:
        step, link, length = self.step, self.link, self.length
        last = 0
        for c in passage:
            known = step[last].get(c)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._split(last, c, known)
                continue
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            while last >= 0 and c not in step[last]:
                step[last][c] = new
                last = link[last]
            if last >= 0:
                q = step[last][c]
                link[new] = q if length[q] == length[last] + 1 else self._split(last, c, q)
            last = new


def repeats(passages: list[list[int]], window: int, owners: list[int] | None = None) -> list[np.ndarray]:
    """For each passage, which of its windows also stand in one of an owner before it; each is its own owner if none are given.

    The passages of an owner are neighbours in the list; all are matched before any of them is added.
    """
    owners = list(range(len(passages))) if owners is None else owners
    automaton, found, start = Automaton(), [], 0
    while start < len(passages):
        end = start
        while end < len(passages) and owners[end] == owners[start]:
            found.append(automaton.matches(passages[end], window))
            end += 1
        if end < len(passages):
            for passage in passages[start:end]:
                automaton.add(passage)
        start = end
    return found


def _ranges(flags: np.ndarray) -> list[dict[str, int]]:
    turns = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in zip(turns[::2].tolist(), turns[1::2].tolist())]


RANGES = "array<struct<start:int,end:int>>"
#: Words of a reference shard, about; one longer text is a shard of its own.
SHARD_WORDS = 200_000


def matching_spans(df: DataFrame, reference: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``text`` and ``spans``, the maximal word ranges covered by ``window`` words that also stand in the reference.

    Both tables have the same id and text columns.  The reference is dealt into shards of bounded
    size; the suffix automaton of one at a time is broadcast, documents stream past it, and for each
    word the length of the longest match that ends there is taken.  The driver and each task hold one
    shard.  Null texts have no words; without a reference there are no spans, and an empty table
    gives no rows.
    """
    spark = df.sparkSession
    held = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = held.withColumn("spans", F.array().cast(RANGES))
    sizes = reference.select(F.col(text_col).alias("text")).where("text is not null").withColumn("n", F.size(F.split("text", "[ \\t-\\r]+"))).where(F.col("n") >= window)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    n_shards = -(-total // SHARD_WORDS)
    for shard in range(n_shards):
        automaton = Automaton()
        for row in sizes.where(F.pmod(F.xxhash64("text"), F.lit(n_shards)) == shard).select("text").distinct().toLocalIterator():
            automaton.add(codes().of(row["text"].encode().split()).tolist())
        sent = spark.sparkContext.broadcast(automaton)

        def matched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 1, SLICE_BYTES):
                spans = []
                for raw, before in zip(utf8(part.column(1)), part.column(2).to_pylist()):
                    code = codes().of(raw.split())
                    cover = np.zeros(len(code) + 1, dtype=np.int64)
                    at = np.flatnonzero(sent.value.matches(code.tolist(), window)) if len(code) >= window else []
                    for start, end in [(b["start"], b["end"]) for b in before] + [(k, k + window) for k in at]:
                        cover[start] += 1
                        cover[end] -= 1
                    spans.append(_ranges(np.cumsum(cover[:-1]) > 0))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["id", "text", "spans"])

        found = cut(found.mapInArrow(matched, found.schema))
        sent.destroy()
    return found.withColumnRenamed("id", id_col)


def repeated_passages(df: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_words``, ``spans`` (removed word ranges: start, end), ``n_removed``, ``kept_sha256``.

    Words stand between ASCII white space and are compared unchanged.  Every word covered by a
    repeated window is removed, judged on the input as it is.  ``kept_sha256`` is the digest of the
    kept words joined by one space.  A null text has no words.  A row with a null id neither removes
    nor loses words; rows with equal ids don't remove each other's.  Repeated rows give repeated
    results and an empty table none.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.xxhash64("id", "text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE_BYTES):
            n_words, blobs, kept, anchors = [], [], [], []
            for raw in utf8(part.column(1)):
                words = raw.split()
                n_words.append(len(words))
                blobs.append(hashlib.sha256(raw).digest())
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
                anchors.append(np.unique(anchored_runs(codes().of(words), window)[0]) if len(words) >= window else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n_words, pa.int64()), pa.array(blobs, pa.binary()), pa.array(kept), pa.array(anchors, pa.list_(pa.int64()))], names=["id", "row", "n_words", "blob", "kept_sha256", "anchors"])

    sketched = cut(docs.mapInArrow(sketch, "id long, row long, n_words long, blob binary, kept_sha256 string, anchors array<long>"))
    # a copy of a whole earlier text is settled here; only the first of equal texts goes on
    first = sketched.where("n_words >= {}".format(window)).groupBy("blob").agg(F.min("id").alias("first")).withColumnRenamed("blob", "blob_")
    marked = sketched.join(first, F.col("blob") == F.col("blob_"), "left").select("id", "row", "n_words", "kept_sha256", "anchors", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("copy"))
    anchors = marked.where("not copy and id is not null").select("id", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select(F.col("anchor").alias("shared"))
    wanted = anchors.join(shared, F.col("anchor") == F.col("shared"), "left_semi").groupBy(F.col("id").alias("id_")).agg(F.collect_set("anchor").alias("wanted"))
    originals = marked.where("not copy").select(F.col("id").alias("id_"), F.col("row").alias("row_")).distinct()
    wanted = wanted.join(originals, "id_").hint("shuffle_hash")

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE_BYTES):
            runs: list[list[dict]] = []
            for raw, held in zip(utf8(part.column(1)), part.column(3)):
                code = codes().of(raw.split())
                own = []
                if len(code) >= window:
                    anchor, start, n = anchored_runs(code, window)
                    for k in np.flatnonzero(np.isin(anchor, held.values.to_numpy(zero_copy_only=False))).tolist():
                        words = code[start[k] : start[k] + n[k] + window - 1].tobytes()
                        own.append({"anchor": int(anchor[k]), "digest": hashlib.md5(words).digest(), "start": int(start[k]), "windows": int(n[k]), "words": words})
                runs.append(own)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(runs, RUN)], names=["id", "text", "row", "runs"])

    RUN = pa.list_(pa.struct([("anchor", pa.int64()), ("digest", pa.binary()), ("start", pa.int32()), ("windows", pa.int32()), ("words", pa.binary())]))
    path = f"{shared_folder(spark)}/passages-{uuid.uuid4().hex}"
    candidates = docs.join(wanted, (F.col("id") == F.col("id_")) & (F.col("row") == F.col("row_"))).select("id", "text", "row", "wanted")
    candidates.mapInArrow(ship, "id long, text string, row long, runs array<struct<anchor:long,digest:binary,start:int,windows:int,words:binary>>").write.option("compression", "zstd").parquet(path)
    shipped = spark.read.parquet(path)
    runs = shipped.select("id", "row", F.explode("runs").alias("run")).select("id", "row", "run.*")
    # equal passages once, with their first document
    passages = cut(runs.groupBy("anchor", "digest").agg(F.min("id").alias("id"), F.first("words").alias("words")))
    sizes = passages.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    sized = passages.join(sizes, "anchor")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
            group.sort(key=lambda r: (r[1], r[0]))
            found = repeats([np.frombuffer(words, dtype=np.uint64).tolist() for _, _, words in group], window, [i for _, i, _ in group])
            hits = []
            for (digest, _, _), flags in zip(group, found):
                hits.append((digest, _ranges(flags)))
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.binary()), pa.array([h[1] for h in hits], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["digest", "hits"])

        anchor, group = None, []
        for batch in batches:
            for a, digest, i, words in zip(*(c.to_pylist() for c in batch.columns)):
                if a != anchor and group:
                    yield done(group)
                    group = []
                anchor = a
                group.append((digest, i, words))
        if group:
            yield done(group)

    small = sized.where(F.col("n") <= GROUP_RUNS).select("anchor", "digest", "id", "words")
    by_automaton = small.repartition(F.col("anchor")).sortWithinPartitions("anchor").mapInArrow(walk, f"digest binary, hits {RANGES}")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, i, words in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(words) // 8 - window + 1
                keys = [hashlib.md5(words[8 * k : 8 * (k + window)]).digest() for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([digest] * n, pa.binary()), pa.array([i] * n, pa.int64()), pa.array(keys, pa.binary()), pa.array(range(n), pa.int32())], names=["digest", "id", "key", "at"])

    large = sized.where(F.col("n") > GROUP_RUNS).select("digest", "id", "words").mapInArrow(windows, "digest binary, id long, key binary, at int")
    earliest = large.groupBy(F.col("key").alias("key_")).agg(F.min("id").alias("low"))
    by_window = large.join(earliest, F.col("key") == F.col("key_")).where("low < id").groupBy("digest").agg(F.collect_list(F.struct(F.col("at").alias("start"), (F.col("at") + 1).alias("end"))).alias("hits"))
    hits = by_automaton.unionByName(by_window).where(F.size("hits") > 0)
    known = passages.select(F.col("digest").alias("digest_"), F.col("id").alias("low"))
    placed = runs.select("id", "row", "digest", "start", "windows").join(known, F.col("digest") == F.col("digest_"))
    later = placed.where("id > low").select("id", "row", "start", (F.col("start") + F.col("windows")).alias("end"))
    own = placed.where("id = low").join(hits.withColumnRenamed("digest", "hit"), F.col("digest") == F.col("hit"))
    own = own.select("id", "row", "start", F.explode("hits").alias("h")).select("id", "row", (F.col("start") + F.col("h.start")).alias("start"), (F.col("start") + F.col("h.end")).alias("end"))
    removed = later.unionByName(own).distinct().groupBy(F.col("id").alias("id_"), F.col("row").alias("row_")).agg(F.array_sort(F.collect_list(F.struct("start", (F.col("end") + window - 1).alias("end")))).alias("ranges"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, SLICE_BYTES):
            spans, kept = [], []
            for raw, ranges in zip(utf8(part.column(2)), part.column(3).to_pylist()):
                words = np.array(raw.split(), dtype=object)
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                for r in ranges:
                    cover[r["start"]] += 1
                    cover[r["end"]] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                spans.append(_ranges(gone))
                kept.append(hashlib.sha256(b" ".join(words[~gone].tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept)], names=["id_", "row_", "spans", "kept"])

    texts = shipped.select("id", "row", "text").dropDuplicates(["id", "row"])
    cleaned = texts.join(removed.hint("shuffle_hash"), (F.col("id") == F.col("id_")) & (F.col("row") == F.col("row_"))).select("id", "row", "text", "ranges")
    cleaned = cleaned.mapInArrow(keep, f"id_ long, row_ long, spans {RANGES}, kept string")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    joined = marked.drop("anchors").join(cleaned, (F.col("id") == F.col("id_")) & (F.col("row") == F.col("row_")), "left")
    spans = F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", F.array().cast(RANGES)))
    kept = F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "kept_sha256"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return joined.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "n_words", spans.alias("spans"), kept.alias("kept_sha256")).withColumn("n_removed", n_removed)
