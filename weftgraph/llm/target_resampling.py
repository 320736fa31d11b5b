"""Importance resampling of documents towards a target: hashed word features, log-ratio gains, Gumbel draws.

Features are runs of words; a feature's bucket is the CRC-32 of its bytes modulo the number of
buckets.  What a bucket holds in all documents and in all target texts gives its gain, a document's
gains add up to its weight, and a draw without replacement takes the highest weights after Gumbel
noise, which comes from a hash of the id.

CRCs are worked out for the distinct features of a slice of texts at once: features of equal length
are a matrix of bytes, and all their CRCs are updated column by column.  Long features are cut into
blocks of BLOCK bytes, which are rows of one matrix; a CRC is linear, so a table that runs BLOCK
zero bytes through it puts the blocks together again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import dense_ids

from .common import cut, slices, utf8
from .suffix_decontam import WORD_BYTES

BUCKETS = 10_000
SLICE_BYTES = 2 << 20
BLOCK = 64
ALL_ONES = np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    """The CRC-32 of each byte, without the ones before and after, by the polynomial's rule."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


def updated(crc: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of a matrix, a row each, column by column."""
    table = byte_table()
    for column in columns.T:
        crc = crc >> np.uint32(8) ^ table[(crc ^ column) & np.uint32(0xFF)]
    return crc


@lru_cache(maxsize=1)
def block_tables() -> np.ndarray:
    """What BLOCK zero bytes make of each byte of a register, by its place."""
    registers = (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    return updated(registers, np.zeros((len(registers), BLOCK), dtype=np.uint8)).reshape(4, 256)


def crc_matrix(rows: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each row of a matrix of bytes."""
    n, length = rows.shape
    head = length % BLOCK
    crc = updated(np.full(n, ALL_ONES, dtype=np.uint32), rows[:, :head])
    count = length // BLOCK
    if count:
        blocks = rows[:, head:].reshape(n * count, BLOCK)
        own = updated(np.zeros(n * count, dtype=np.uint32), blocks).reshape(n, count)
        tables = block_tables()
        for k in range(count):
            moved = tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]
            crc = moved ^ own[:, k]
    return crc ^ ALL_ONES


def crc_by_length(features: list[bytes]) -> np.ndarray:
    """The unsigned CRC-32 of each feature: equal lengths together, the results scattered back."""
    out = np.zeros(len(features), dtype=np.int64)
    lengths = np.fromiter(map(len, features), dtype=np.int64, count=len(features))
    order = np.argsort(lengths, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(places):
            held = b"".join([features[k] for k in places.tolist()])
            out[places] = crc_matrix(np.frombuffer(held, dtype=np.uint8).reshape(len(places), int(lengths[places[0]])))
    return out


def word_runs(words: list[bytes], ngrams: tuple[int, int]) -> list[bytes]:
    """All runs of words of the given lengths, joined by a space, repeats included."""
    if ngrams == (1, 1):
        return words
    return [b" ".join(words[k : k + n]) for n in range(ngrams[0], ngrams[1] + 1) for k in range(len(words) - n + 1)]


def hashed(raws: list[bytes], ngrams: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature)."""
    numbers: dict[bytes, int] = {}
    n_words, sizes, codes = [], [], []
    for raw in raws:
        words = raw.translate(WORD_BYTES).split()
        own = word_runs(words, ngrams)
        n_words.append(len(words))
        sizes.append(len(own))
        codes.append(np.fromiter([numbers.setdefault(f, len(numbers)) for f in own], dtype=np.int64, count=len(own)))
    at = crc_by_length(list(numbers)) % buckets
    flat = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64)
    return np.array(n_words, dtype=np.int64), np.repeat(np.arange(len(raws)), sizes), at[flat]


def bucket_counts(df: DataFrame, text_col: str, ngrams: tuple[int, int], buckets: int) -> np.ndarray:
    """How many features of all texts each bucket holds.  A task gives a row a bucket, and the driver gets ``buckets`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for part in slices(batches, 0, SLICE_BYTES):
            held += np.bincount(hashed([raw or b"" for raw in utf8(part.column(0))], ngrams, buckets)[2], minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "n"])

    counts = np.zeros(buckets, dtype=np.int64)
    for row in df.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket, in doubles."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(id_: Column, seed: str) -> Column:
    """Gumbel noise in thousandths from the first 8 hex digits of the SHA-256 of ``seed:id``; a null id is an empty text there."""
    hex_ = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8)
    unit = (F.conv(hex_, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(unit))).cast("long")


def resample(df: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, ngrams: tuple[int, int] = (1, 1), buckets: int = BUCKETS, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` (from 1; null if not drawn).

    Of the rows with ``least_words`` words or more the ``percent`` of the highest scores are drawn,
    rounded down; ties go to the smaller id, null first, and rows alike in both follow in any order.
    A null or empty text has no features and weight 0.  Repeated rows count and compete as often as
    they occur.  Without a target or documents the counts are zeros; an empty table gives no rows.
    Other columns are left out.  Texts are read twice and never shuffled.
    """
    gain = gains(bucket_counts(df, text_col, ngrams, buckets), bucket_counts(target, target_text_col, ngrams, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE_BYTES):
            n_words, owner, at = hashed([raw or b"" for raw in utf8(part.column(1))], ngrams, buckets)
            n = np.bincount(owner, minlength=len(n_words))
            # sums of whole numbers: exact
            weight = np.bincount(owner, weights=gain[at], minlength=len(n_words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words), pa.array(n), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    id_type = df.schema[id_col].dataType.simpleString()
    weighed = df.select(F.col(id_col).alias("id"), text_col).mapInArrow(weigh, f"id {id_type}, n_words long, n_features long, weight long")
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    ordered = dense_ids(able.withColumn("down_", -F.col("score")), "down_", "id", name="before_").drop("down_")
    ranked = ordered.select(*scored.columns, F.when(F.col("before_") < drawn, F.col("before_") + 1).alias("rank"))
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).withColumnRenamed("id", id_col)
