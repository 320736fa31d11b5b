"""Shards of near-equal bytes by a histogram sort, in DataFrame functions only.

Rows are ordered by a key.  Rounds of counting find, for each of the boundaries between shards, the
key below which the wanted number of bytes lies: a round counts bytes and rows in equal steps of
every key range that still holds a boundary (at most ``steps`` counters per range reach the
driver), and the next round looks only into the step that holds it.  When each splitter is exact,
rows are exchanged once, in many small runs of keys, and numbered by the counts of the runs before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_filter

#: Keys are below 2 ** KEY_BITS.
KEY_BITS = 60
#: Rows of one run of the exchange, about.
RUN_ROWS = 4096


def hashed_key(*columns: Column) -> Column:
    """A key spread evenly over [0, 2 ** 60): the first 15 hex digits of an MD5."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def spread_repeats(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the keys that several rows share replaced by hashes of the key and a row number, so that such rows spread over all keys.

    A bitmap of fixed size says which keys repeat; the few others that it takes along get a new key too.
    """
    rows = cut(df)
    repeated = rows.groupBy(key).agg(F.count("*").alias("n_")).where("n_ > 1").select(key)
    if repeated.isEmpty():
        return rows
    return rows.withColumn(key, F.when(in_filter(repeated, key), hashed_key(F.col(key), F.monotonically_increasing_id())).otherwise(F.col(key)))


def splitters(rows: DataFrame, key: str, size: str, n_shards: int, steps: int = 1024) -> list[int]:
    """For each shard but the first, the least key with at least its share of all bytes below it."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    # a boundary: its number, and a range (low, high] of keys with the bytes below low and the width
    open_ = {i: (0, 1 << KEY_BITS, 0) for i in range(1, n_shards)} if total else {}
    done: dict[int, int] = {}
    while open_:
        ranges = sorted({(low, high) for low, high, _ in open_.values()})
        step = {low: max(1, -(-(high - low) // steps)) for low, high in ranges}
        which = F.lit(None).cast("long")
        at = F.lit(None).cast("long")
        for low, high in ranges:
            inside = (F.col(key) >= low) & (F.col(key) < high)
            which = F.when(inside, F.lit(low)).otherwise(which)
            at = F.when(inside, F.expr(f"(`{key}` - {low}L) div {step[low]}L")).otherwise(at)
        counted = rows.select(which.alias("low"), at.alias("at"), size).where(F.col("low").isNotNull()).groupBy("low", "at").agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
        counts: dict[int, list] = {}
        for row in counted.collect():  # at most n_shards * steps counters
            counts.setdefault(row["low"], []).append((row["at"], row["bytes"], row["n"]))
        for i, (low, high, below) in list(open_.items()):
            for k, held, n in sorted(counts[low]):
                if n_shards * (below + held) >= i * total:
                    start, end = low + k * step[low], min(high, low + (k + 1) * step[low])
                    if n == 1 or end - start == 1:
                        done[i] = end
                        del open_[i]
                    else:
                        open_[i] = (start, end, below)
                    break
                below += held
    return [done[i] for i in range(1, n_shards)] if total else []


def shards_by_bytes(df: DataFrame, key: Column, size: Column, n_shards: int = 16, tie_cols: tuple[str, ...] = ("doc_id",), spread: bool = False) -> DataFrame:
    """``df`` with ``size``, ``shard`` and ``slot``: the place in the shard, gapless from 0, in key order.

    A row's shard is ``floor(n_shards * bytes below its key / all bytes)``, so shards differ by a row
    at most from equal bytes.  Rows of one key stay together; ``tie_cols`` order them, and rows
    alike in all of these are numbered in any order.  With ``spread``, for keys whose order says
    nothing, rows of a repeated key are spread instead, so that any number of repeated rows leaves
    the shards equal.  ``df`` should hold only the columns to place.
    An empty table gives no rows; sizes must be positive and keys in [0, 2 ** 60).
    """
    rows = df.select(*[F.col(c) for c in df.columns], key.alias("key_"), size.cast("long").alias("size_"))
    rows = cut(spread_repeats(rows, "key_") if spread else rows)
    bounds = splitters(rows, "key_", "size_", n_shards)
    shard = F.lit(0)
    for bound in bounds:
        shard = shard + (F.col("key_") >= bound).cast("int")
    runs = max(1, rows.count() // RUN_ROWS)
    shift = max(0, KEY_BITS - (runs - 1).bit_length())
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("run_", F.shiftright("key_", shift))
    counts = placed.groupBy("shard", "run_").agg(F.count("*").alias("n_"))
    before = counts.withColumn("before_", F.sum("n_").over(Window.partitionBy("shard").orderBy("run_")) - F.col("n_")).select(F.col("shard").alias("s_"), F.col("run_").alias("r_"), "before_")
    numbered = placed.withColumn("slot_", F.row_number().over(Window.partitionBy("shard", "run_").orderBy("key_", *tie_cols)) - 1)
    joined = numbered.join(before, (F.col("shard") == F.col("s_")) & (F.col("run_") == F.col("r_")))
    return joined.select(*df.columns, F.col("size_").alias("size"), "shard", (F.col("slot_") + F.col("before_")).cast("long").alias("slot"))
