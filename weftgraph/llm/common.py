"""Helpers that every corpus operator shares: shared storage, lineage cuts and row batching."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bits of the fixed-size filters that spare rows that can't match a shuffle.
FILTER_BITS = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset, a temporary folder is made
    and registered in local mode, as in tests; a cluster must name a shared one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text; a null text counts as empty.  Other columns cannot clash with later ones."""
    return df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))


def long_columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a small table of longs, on the driver, as arrays."""
    table = df.toArrow()
    return [column.to_numpy() for column in table.columns]


def in_filter(wanted: DataFrame, key: str) -> Column:
    """A condition on ``key`` that holds wherever ``wanted`` has it: a bitmap of fixed size."""
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    words = wanted.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    bits = [0] * (FILTER_BITS // 64)
    for row in words.collect():  # at most FILTER_BITS / 64 rows
        bits[row["w"]] = row["b"]
    held = F.element_at(F.lit(np.array(bits, dtype=np.int64)), (F.floor(place / 64) + 1).cast("int"))
    return F.getbit(held, (place % 64).cast("int")) == 1


def marked(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``df`` with ``may_``, true wherever ``wanted`` has the ``key``: a bitmap of fixed size.

    Its words, at most FILTER_BITS / 64 rows, are joined by broadcast, so no plan holds the bitmap.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    at = (place / 64).cast("int")
    words = cut(wanted.select(place.alias("p")).groupBy((F.col("p") / 64).cast("int").alias("word_")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits_")))
    held = df.join(F.broadcast(words), at == F.col("word_"), "left")
    return held.withColumn("may_", F.coalesce(F.getbit("bits_", (place % 64).cast("int")) == 1, F.lit(False))).drop("word_", "bits_")


def set_apart(df: DataFrame, *results: str) -> DataFrame:
    """``df`` with the columns that are named like a result renamed: ``_in`` is added until no name is left twice."""
    taken = {name.lower() for name in (*df.columns, *results)}
    names = []
    for name in df.columns:
        if name.lower() in {r.lower() for r in results}:
            while name.lower() in taken:
                name += "_in"
            taken.add(name.lower())
        names.append(name)
    return df.toDF(*names)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start, held = 0, 0
        for row, size in enumerate(sizes):
            size = size or 0
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
