"""Similarity graphs: metric joins of rows, thresholds, nearest neighbours, inverted indexes of discrete tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import dense_ids, segmented_ranks, unique_name
from weftgraph.operators.linkage import cluster_order
from weftgraph.operators.matrix import median_and_mad, tokenise_discrete
from weftgraph.plans.iterate import cut

#: Rows of one side of a block pair at least, blocks into which all rows are cut about, and bytes of numbers of one side at most.
BLOCK = 512
BLOCKS = 12
SIDE = 64 << 20
#: Equal rows that go as one at most; scores held at once, and members passed on at once.
MEMBERS = 256
SCORES = 1 << 20
#: Rows of one token that are worth a block of their own, since a block pair writes out up to the square of that.
ROWS = 8192
#: Pivots of a metric join at most, and rows of a cell, about.
PIVOTS = 512
CELL = 128


def vectors(m: DataFrame) -> DataFrame:
    """(row, v): the cells of each row in column order; rows with a missing cell are left out."""
    cells = m.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce("x", F.lit(float("nan"))).alias("x")))).alias("c"))
    return cells.select("row", F.transform("c", lambda s: s["x"]).alias("v")).where(~F.exists("v", F.isnan))


def pearson_rows(vectors_: DataFrame) -> DataFrame:
    """Rows centred and of length 1, so that a dot product is Pearson's r; constant rows are left out."""
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    centred = vectors_.withColumn("m_", mean).select("row", F.transform("v", lambda x: x - F.col("m_")).alias("v"))
    return cosine_rows(centred)


def cosine_rows(vectors_: DataFrame) -> DataFrame:
    """Rows of length 1; zero rows are left out."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return vectors_.withColumn("n_", norm).where("n_ > 1e-12").select("row", F.transform("v", lambda x: x / F.col("n_")).alias("v"))


def spearman_rows(m: DataFrame) -> DataFrame:
    """Rows of descending ranks, ties sharing the first, ready as for Pearson."""
    order = Window.partitionBy("row").orderBy(F.desc("x"))
    return pearson_rows(vectors(m.withColumn("x", F.rank().over(order).cast("double"))))


def bicor_rows(m: DataFrame) -> DataFrame:
    """Rows weighted for the biweight midcorrelation; rows of zero median deviation are left out."""
    stats = median_and_mad(m).select(F.col("row").alias("r_"), "median", "mad").where("mad > 0")
    u = (F.col("x") - F.col("median")) / (9 * F.col("mad"))
    weighted = F.when(1 - u * u > 0, (F.col("x") - F.col("median")) * F.pow(1 - u * u, 2)).otherwise(0.0)
    return cosine_rows(vectors(m.join(stats, F.col("row") == F.col("r_")).select("row", "col", weighted.alias("x"))))


def reach(threshold: float, polarity: str, kind: str) -> float | None:
    """The distance beyond which no pair passes; None where there is none.  Rows of length 1 differ by sqrt(2 - 2 r)."""
    if kind == "euclidean":
        return 1 / threshold - 1 if threshold > 0 else None
    bound = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    return bound if bound < 2 else None


def metric_cells(rows: DataFrame, bound: float | None, polarity: str = "positive", pivots: int | None = None) -> DataFrame:
    """``rows`` (row, v) with ``cell``, that of the nearest pivot, and ``visits``, the later cells that may hold a row within ``bound``.

    Pivots are rows drawn by a hash, PIVOTS at most, which the driver holds.  A row reaches a cell only
    if its distance to the cell's pivot is within ``bound`` of the distances of that cell's own rows,
    and if it is within ``bound`` of the plane between that pivot and its own.  For negative pairs it is
    the opposite row that visits.  Without a bound all rows are one cell.
    """
    held = [c for c in rows.columns if c in ("row", "v", "members")]
    rows = rows.where("row is not null").select(*held)
    one_cell = rows.select(*held, F.lit(0).alias("cell"), F.array().cast("array<int>").alias("visits"))
    if bound is None:
        return one_cell
    wanted = pivots or max(1, min(PIVOTS, rows.count() // CELL))
    drawn = rows.orderBy(F.xxhash64("row"), "row").limit(wanted).collect()
    if not drawn:
        return one_cell
    at = np.unique(np.array([r["v"] for r in drawn], dtype=float), axis=0)
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in held)
    far = lambda x: np.sqrt(np.maximum((x**2).sum(1)[:, None] + (at**2).sum(1) - 2 * x @ at.T, 0))

    def home(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                d = far(np.array(part["v"].tolist()))
                cell = d.argmin(axis=1)
                yield part.assign(cell=cell.astype(np.int32), d=d[np.arange(len(d)), cell])

    homed = cut(rows.mapInPandas(home, f"{fields}, cell int, d double"))
    # a row for each pivot
    rings = {r["cell"]: (r["low"], r["high"]) for r in homed.groupBy("cell").agg(F.min("d").alias("low"), F.max("d").alias("high")).collect()}
    low = np.array([rings.get(c, (np.inf, -np.inf))[0] for c in range(len(at))])
    high = np.array([rings.get(c, (np.inf, -np.inf))[1] for c in range(len(at))])
    apart = np.sqrt(np.maximum((at**2).sum(1)[:, None] + (at**2).sum(1) - 2 * at @ at.T, 1e-300))
    slack = bound + 1e-9

    def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x, cell = np.array(part["v"].tolist()).reshape(len(part), -1), part["cell"].to_numpy()
            near = np.zeros((len(part), len(at)), dtype=bool)
            for sign in {"positive": (1,), "negative": (-1,), "both": (1, -1)}[polarity] if len(part) else ():
                d = far(sign * x)
                own = d.argmin(axis=1)
                plane = (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * np.maximum(apart[own], 1e-9))
                near |= (d <= high + slack) & (d >= low - slack) & ((plane <= slack) | (np.arange(len(at)) == own[:, None]))
            near &= np.arange(len(at)) > cell[:, None]
            yield part.assign(visits=[np.flatnonzero(n).astype(np.int32) for n in near])[[*held, "cell", "visits"]]

    return homed.mapInPandas(visit, f"{fields}, cell int, visits array<int>")


def pairs_compared(cells: DataFrame) -> DataFrame:
    """(compared, all): how many pairs of rows meet by their cells, and how many there are."""
    home = cells.groupBy("cell").agg(F.count("*").alias("n"))
    visits = cells.select(F.explode("visits").alias("to")).groupBy("to").agg(F.count("*").alias("m"))
    met = home.join(visits, F.col("cell") == F.col("to"), "left").agg(F.sum(F.expr("n * (n - 1) div 2 + n * coalesce(m, 0)")).alias("compared"), F.sum("n").alias("rows"))
    return met.select(F.coalesce("compared", F.lit(0)).alias("compared"), F.coalesce(F.expr("rows * (rows - 1) div 2"), F.lit(0)).alias("all"))


def classes(rows: DataFrame) -> DataFrame:
    """(row, v, members): the rows of equal ``v`` as one, named by the least; more than MEMBERS of them are several."""
    placed = segmented_ranks(rows.where("row is not null").select("row", "v"), "v", "row", place="place", size="held")
    part = ((F.col("place") - 1) / MEMBERS).cast("long")
    return cut(placed.groupBy("v", part.alias("part")).agg(F.array_sort(F.collect_list("row")).alias("members")).select(F.col("members")[0].alias("row"), "v", "members"))


def _block_rows(classes_: DataFrame) -> int:
    """Classes of a block: a share of all, so that copies of one don't grow with the input; BLOCK rows at least, and what a task holds at most."""
    seen = classes_.agg(F.count("*").alias("n"), F.sum(F.size("members")).alias("rows"), F.max(F.size("v")).alias("width")).first()
    least = BLOCK * seen["n"] // max(1, seen["rows"] or 1)
    return max(1, least, min(-(-seen["n"] // BLOCKS), SIDE // (8 * max(1, seen["width"] or 1))))


def _token_blocks(size: int) -> Column:
    """Blocks of a token with ``m`` classes of ``rows`` rows: by ``size``, or up to BLOCKS where few classes stand for many rows."""
    by_size, by_rows = F.ceil(F.col("m") / size), F.ceil(F.col("rows") / ROWS)
    return F.greatest(by_size, F.least(by_rows, F.col("m"), F.lit(BLOCKS))).cast("int")


def _dealt(sides: DataFrame, *keys: str) -> DataFrame:
    """Block pairs over all shuffle partitions: few bytes make many pairs, so partitions are not to be joined by their size."""
    return sides.repartition(int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sides(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Table, bool]:
    """The two sides of a block pair, each sorted by row; a block that meets itself comes once."""
    table = pa.Table.from_batches(list(batches)).sort_by("row")
    side = table["side"].to_numpy()
    inside = table["i"][0].as_py() == table["j"][0].as_py()
    return table.filter(pa.array(side == 0)), table.filter(pa.array(side == (0 if inside else 1))), inside


def _row_bars(score: np.ndarray, limit: int) -> np.ndarray:
    """The ``limit``-th best score of each row; a copy, as a view would hold all scores of its slice, and so all slices those of the block pair."""
    if score.shape[1] <= limit:
        return np.full(len(score), -np.inf)
    return np.partition(score, -limit, axis=1)[:, -limit].copy()


def _passed_on(a: pa.Table, b: pa.Table, p: np.ndarray, q: np.ndarray, r: np.ndarray, same: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(x, y, r, same): the members of both sides of the pairs, in batches of bounded size."""
    x, y = (side["members"].combine_chunks().cast(pa.list_(side.schema.field("members").type.value_type)) for side in (a, b))
    weight = np.cumsum(x.value_lengths().to_numpy()[p].astype(np.int64) + y.value_lengths().to_numpy()[q])
    starts = np.r_[0, np.searchsorted(weight, np.arange(SCORES, weight[-1], SCORES), side="right"), len(p)] if len(p) else [0]
    for start, end in zip(starts[:-1], starts[1:]):
        if start < end:
            yield pa.RecordBatch.from_arrays([x.take(pa.array(p[start:end])), y.take(pa.array(q[start:end])), pa.array(r[start:end]), pa.array(same[start:end])], ["x", "y", "r", "same"])


def _expanded(met: DataFrame, digits: int | None) -> DataFrame:
    """(a, b, r) with a < b: each member of one side with each of the other; no exchange."""
    # rounded before there are rows for all members
    once = met.select("x", "y", (F.col("r") if digits is None else F.round("r", digits)).alias("r"), "same")
    pairs = once.select(F.explode("x").alias("p"), "y", "r", "same").select("p", F.explode("y").alias("q"), "r", "same")
    return pairs.where("not same or p < q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "r")


def all_pairs(rows: DataFrame, threshold: float, polarity: str = "positive", kind: str = "dot", limit: int | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, r) with a < b of all pairs of rows (row, v) that pass: r >= t, r <= -t, or |r| >= t; r rounded to ``digits``.

    ``kind``: ``dot`` (of rows of length 1, if the threshold is above -1), ``euclidean`` (1 / (1 + distance)),
    or ``smc`` and ``jaccard`` over tokens, which go to ``token_pairs`` if the threshold is above 0.
    Equal rows are compared as one (``classes``), and their pairs are written out at the end.
    A threshold is a distance that pairs may have at most, so rows are dealt into the cells of pivots
    and visit the cells that they can reach (``metric_cells``); a pair meets in the later of its two
    cells.  Where pivots rule out less than half of the pairs, all rows are one cell.  A cell's rows and
    visitors are dealt into blocks, about BLOCKS of all rows; each pair of blocks meets in one task, which multiplies slices of them as matrices and lets only survivors out.
    With ``limit``, a task passes on just the pairs in either row's first ``limit`` of that block pair
    and those that tie with them, which keeps every global first.
    """
    discrete = kind in ("smc", "jaccard")
    if discrete and threshold > 0:
        return token_pairs(rows, threshold, kind, digits)
    cells = cut(metric_cells(classes(rows), None if discrete else reach(threshold, polarity, kind), polarity))
    met = pairs_compared(cells).first()
    if 2 * met["compared"] > met["all"]:  # a row would be copied into most cells for nothing
        cells = cells.withColumn("cell", F.lit(0)).withColumn("visits", F.array().cast("array<int>"))
    size = _block_rows(cells)
    visited = cells.select(F.explode("visits").alias("to")).groupBy("to").agg(F.ceil(F.count("*") / size).cast("int").alias("guests"))
    blocks = cells.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks")).join(visited, F.col("cell") == F.col("to"), "left").select(F.col("cell").alias("cell_"), "blocks", F.coalesce("guests", F.lit(0)).alias("guests"))
    blocks = F.broadcast(cut(blocks))  # a row for each pivot
    home = cells.join(blocks, F.col("cell") == F.col("cell_")).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    guest = cells.select("row", "v", "members", F.explode("visits").alias("cell")).join(blocks, F.col("cell") == F.col("cell_"))
    # the block pair (i, j) of a cell, i < j, gets the rows of both, (i, i) those of block i, and (i, -j) those of block i and of the visitors' block j
    shown = ["row", "v", "members", "cell"]
    left = home.select(*shown, F.col("block").alias("i"), F.explode(F.concat(F.sequence("block", F.col("blocks") - 1), F.when(F.col("guests") > 0, F.sequence(-F.col("guests"), F.lit(-1))).otherwise(F.array().cast("array<int>")))).alias("j"), F.lit(0).alias("side"))
    right = home.where("block > 0").select(*shown, F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))
    comes = guest.select(*shown, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), (-1 - F.pmod(F.xxhash64("row"), F.col("guests"))).cast("int").alias("j"), F.lit(1).alias("side"))
    row_type = rows.schema["row"].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, inside = _sides(batches)
        if not len(a) or not len(b):
            return
        x, y = _matrix(a["v"]), _matrix(b["v"])
        several = a["members"].combine_chunks().value_lengths().to_numpy() > 1
        squares = (y**2).sum(1)
        step = max(1, SCORES // len(y))

        def slices() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for start in range(0, len(x), step):
                part = x[start : start + step]
                if kind == "dot":
                    r = part @ y.T
                elif kind == "euclidean":
                    r = 1 / (1 + np.sqrt(np.maximum((part**2).sum(1)[:, None] + squares - 2 * part @ y.T, 0)))
                else:
                    r = token_similarity(part[:, None, :], y[None, :, :], kind)
                passed = {"positive": r >= threshold, "negative": r <= -threshold, "both": np.abs(r) >= threshold}[polarity] & ~np.isnan(r)
                if inside:  # a row meets itself if it stands for several
                    at = np.arange(len(part))
                    passed[at, start + at] &= several[start : start + step]
                yield start, r, passed

        if limit is not None:
            bars, best = [], np.full((limit, len(y)), -np.inf)
            for _, r, passed in slices():
                score = np.where(passed, np.abs(r), -np.inf)
                bars.append(_row_bars(score, limit))
                best = np.partition(np.vstack([best, score]), -limit, axis=0)[-limit:]
            rows_bar, columns_bar = np.concatenate(bars) - 1e-12, best.min(axis=0) - 1e-12  # ties, rounding apart, pass
        for start, r, passed in slices():
            if limit is not None:
                score = np.abs(r)
                passed &= (score >= rows_bar[start : start + step, None]) | (score >= columns_bar)
            if inside:
                passed &= np.arange(len(y)) >= start + np.arange(len(r))[:, None]
            p, q = np.nonzero(passed)
            yield from _passed_on(a, b, p + start, q, r[p, q], inside & (p + start == q))

    met = _dealt(left.unionByName(right).unionByName(comes), "cell", "i", "j").groupBy("cell", "i", "j").applyInArrow(meet, f"x array<{row_type}>, y array<{row_type}>, r double, same boolean")
    return _expanded(met, digits)


def token_similarity(x: np.ndarray, y: np.ndarray, kind: str) -> np.ndarray:
    """Shares of equal tokens along the last axis: of all columns, or for ``jaccard``, zero tokens apart, of those where either has one."""
    if kind == "smc":
        return (x == y).sum(axis=-1) / x.shape[-1]
    either = ((x != 0) | (y != 0)).sum(axis=-1)
    return ((x == y) & (x != 0)).sum(axis=-1) / np.maximum(either, 1)


def token_pairs(rows: DataFrame, threshold: float, kind: str = "jaccard", digits: int | None = None) -> DataFrame:
    """(a, b, r) with a < b of the rows of tokens (row, v) with a Jaccard or matching similarity of ``threshold`` (above 0) or more.

    Equal rows are compared as one (``classes``), and their pairs are written out at the end.
    An inverted index over (column, token): pairs that pass share ceil(threshold * n) of the n tokens
    of either, so they share one of its n - that + 1 rarest.  Only these are indexed, the rarest
    first in one order for all rows.  ``jaccard`` indexes no zero tokens and rows without others
    match nothing; rows of one length match only lengths within ``threshold`` of it.  The rows of a
    token, however many, are dealt into blocks, block pairs meet in one task each, and a pair that
    meets under several tokens is kept under the first.
    """
    names = classes(rows)
    cells = names.select("row", F.posexplode("v").alias("col", "token"))
    if kind == "jaccard":
        cells = cells.where("token <> 0")
    counts = cells.groupBy(F.col("col").alias("c_"), F.col("token").alias("t_")).agg(F.count("*").alias("often"))
    items = F.array_sort(F.collect_list(F.struct("often", "col", "token")))
    ordered = cells.join(counts, (F.col("col") == F.col("c_")) & (F.col("token") == F.col("t_"))).groupBy(F.col("row").alias("r_")).agg(items.alias("items"))
    # the least overlap, with a little less for rounding
    overlap = F.greatest(F.ceil(F.size("items") * F.lit(threshold) - F.lit(1e-9)), F.lit(1))
    prefixed = names.join(ordered, F.col("row") == F.col("r_")).withColumn("rare", F.slice("items", F.lit(1), (F.size("items") - overlap + 1).cast("int")))
    # where each column's token stands among the row's rarest; -1 if it is none of them
    prefixed = prefixed.withColumn("places", F.expr("transform(sequence(0, size(v) - 1), c -> cast(array_position(transform(rare, x -> x.col), c) as int) - 1)"))
    prefixed = cut(prefixed.select("row", "v", "members", F.size("items").alias("n"), "places", "rare"))
    posted = prefixed.select("row", "v", "members", "n", "places", F.explode("rare").alias("item")).select("*", F.col("item.col").alias("col"), F.col("item.token").alias("token")).drop("item")
    size = _block_rows(prefixed)
    # a hash of the row chooses the block, by the number of the token's rows in the index
    sizes = posted.groupBy(F.col("col").alias("c_"), F.col("token").alias("t_")).agg(F.count("*").alias("m"), F.sum(F.size("members")).alias("rows")).where("m > 1").select("c_", "t_", _token_blocks(size).alias("blocks"))
    dealt = posted.join(sizes, (F.col("col") == F.col("c_")) & (F.col("token") == F.col("t_"))).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    shown = ["row", "v", "members", "n", "places", "col", "token"]
    left = dealt.select(*shown, F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"))
    right = dealt.where("block > 0").select(*shown, F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))
    row_type = rows.schema["row"].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, inside = _sides(batches)
        if not len(a) or not len(b):
            return
        x, y, here = _matrix(a["v"]), _matrix(b["v"]), a["col"][0].as_py()
        n, m = a["n"].to_numpy(), b["n"].to_numpy()
        own, other = _matrix(a["places"]), _matrix(b["places"])
        step = max(1, SCORES // len(y))
        for start in range(0, len(x), step):
            part = slice(start, start + step)
            same = np.zeros((len(x[part]), len(y)), dtype=np.int32)
            either = np.zeros_like(same)
            for k in range(x.shape[1]):
                equal = x[part, k, None] == y[None, :, k]
                if kind == "jaccard":
                    some = (x[part, k, None] != 0) | (y[None, :, k] != 0)
                    same += equal & some
                    either += some
                else:
                    same += equal
            r = same / (x.shape[1] if kind == "smc" else np.maximum(either, 1))
            passed = (r >= threshold) & (np.minimum(n[part, None], m) >= threshold * np.maximum(n[part, None], m) - 1e-9)
            if inside:
                passed &= np.arange(len(y)) > start + np.arange(len(r))[:, None]
            p, q = np.nonzero(passed)
            # no rarer token of both is shared; zero tokens have no place for jaccard
            first = np.ones(len(p), dtype=bool)
            for k in range(x.shape[1]):
                before = (own[p + start, k] >= 0) & (own[p + start, k] < own[p + start, here]) & (other[q, k] >= 0)
                first &= ~(before & (x[p + start, k] == y[q, k]))
            p, q = p[first], q[first]
            yield from _passed_on(a, b, p + start, q, r[p, q], np.zeros(len(p), dtype=bool))

    met = _dealt(left.unionByName(right), "col", "token", "i", "j").groupBy("col", "token", "i", "j").applyInArrow(meet, f"x array<{row_type}>, y array<{row_type}>, r double, same boolean")
    # equal rows with some token
    equals = prefixed.where((F.size("members") > 1) & (F.lit(1.0) >= threshold)).select(F.col("members").alias("x"), F.col("members").alias("y"), F.lit(1.0).alias("r"), F.lit(True).alias("same"))
    return _expanded(met.unionByName(equals), digits)


def top_k_edges(pairs: DataFrame, k: int = 50, signed: bool = False) -> DataFrame:
    """The pairs (a, b, r) among the first k of either end by |r| (``signed``: by r); ties to the smaller other end."""
    strength = F.col("r") if signed else F.abs("r")
    ends = pairs.select("a", "b", "r", F.explode(F.array(F.struct(F.col("a").alias("me"), F.col("b").alias("other")), F.struct(F.col("b").alias("me"), F.col("a").alias("other")))).alias("e"))
    ranked = ends.withColumn("k_", F.row_number().over(Window.partitionBy("e.me").orderBy(strength.desc(), "e.other")))
    return ranked.where(F.col("k_") <= k).select("a", "b", "r").distinct()


def correlation_attributes(pairs: DataFrame, name: str) -> DataFrame:
    """Edges with ``<name> Correlation`` and its absolute value."""
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("r").alias(f"{name} Correlation"), F.abs("r").alias(f"Absolute {name} Correlation"))


def token_rows(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(row, v): tokens of discrete columns, numbered by hash."""
    return df.select(F.col(row).alias("row"), F.array(*[tokenise_discrete(F.col(c).cast("string")) for c in columns]).alias("v"))


def binary_rows(vectors_: DataFrame) -> DataFrame:
    """Continuous rows as 0 and 1, for ``jaccard`` and ``smc``."""
    return vectors_.select("row", F.transform("v", lambda x: (x != 0).cast("long")).alias("v"))


def correlation_matrix(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(i, j, r) with i <= j: the given pairs and 1 on the diagonal."""
    return pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), "r").unionByName(rows.select(F.col("row").alias("i"), F.col("row").alias("j"), F.lit(1.0).alias("r")))


def column_distance(m: DataFrame) -> DataFrame:
    """(a, b, distance) with a < b: Euclidean distance of columns, over the rows where both are present."""
    held = m.where("x is not null")
    other = held.select(F.col("row").alias("r_"), F.col("col").alias("b"), F.col("x").alias("y"))
    met = held.join(other, (F.col("row") == F.col("r_")) & (F.col("col") < F.col("b")))
    return met.groupBy(F.col("col").alias("a"), "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("distance"))


def column_cluster_order(distances: DataFrame) -> DataFrame:
    """(place, col, height): single-linkage leaf order of the columns with the height at which each joins the ones before."""
    return cluster_order(distances).select(F.col("place").cast("int").alias("place"), F.col("v").alias("col"), "height")


def rows_of_interest(m: DataFrame, selected: list[int], weight: float = 1.0, relative: bool = True, percentile: float = 90) -> DataFrame:
    """(row, score, rank): rows whose selected columns' sum, less (``relative``) the mean of the others, is in the top percentiles."""
    chosen = F.col("col").isin(selected)
    others = F.coalesce(F.avg(F.when(~chosen, F.col("x"))), F.lit(0.0)) if relative else F.lit(0.0)
    scored = m.groupBy("row").agg((F.coalesce(F.sum(F.when(chosen, F.col("x"))), F.lit(0.0)) - weight * others).alias("score"))
    bar = scored.agg(F.percentile("score", percentile / 100).alias("bar_"))
    kept = scored.crossJoin(F.broadcast(bar)).where("score >= bar_").select("row", "score")  # one row
    return dense_ids(kept.withColumn("down_", -F.col("score")), "down_", "row", name="rank").select("row", "score", (F.col("rank") + 1).alias("rank"))


def grouped_value_counts(df: DataFrame, group: str, value: str, most: int = 16) -> DataFrame:
    """(group, value, count) of the present values; a group of ``most`` or more different ones has one total with a NULL value."""
    counts = df.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy(F.col(group).alias("group"), F.col(value).cast("string").alias("value")).agg(F.count("*").alias("count"))
    sizes = counts.groupBy(F.col("group").alias("g_")).agg(F.count("*").alias("n_"))
    shown = F.when(F.col("n_") < most, F.col("value"))
    return counts.join(sizes, F.col("group").eqNullSafe(F.col("g_"))).groupBy("group", shown.alias("value")).agg(F.sum("count").alias("count"))


def import_column_annotations(columns: DataFrame, annotations: DataFrame, name: str = "name") -> DataFrame:
    """Annotations joined to columns by name; one of the same name and type is replaced, else the new name is made unique."""
    firsts = annotations.groupBy(F.col(name).alias("k_")).agg(F.min(F.struct(*[c for c in annotations.columns if c != name])).alias("row_"))
    joined = columns.join(firsts, F.col(name) == F.col("k_"), "left")
    for c in (c for c in annotations.columns if c != name):
        same = c in columns.columns and columns.schema[c].dataType == annotations.schema[c].dataType
        joined = joined.withColumn(c if same else unique_name(c, joined.columns), F.col("row_")[c])
    return joined.drop("k_", "row_")


def annotation_profile(df: DataFrame, position: str, value: str) -> DataFrame:
    """(value, index, numeric, unit): distinct values in first-seen order; if all are numbers, each in [0, 1]."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("string").alias("value")).agg(F.min(position).alias("first_"))
    number = F.col("value").try_cast("double")
    span = firsts.agg((F.count(number) == F.count("*")).alias("numeric"), F.min(number).alias("lo_"), F.max(number).alias("hi_"))
    indexed = dense_ids(firsts, "first_", "value", name="index").crossJoin(F.broadcast(span))  # one row
    return indexed.select("value", "index", "numeric", F.when(F.col("numeric"), F.coalesce(F.try_divide(number - F.col("lo_"), F.nullif(F.col("hi_") - F.col("lo_"), F.lit(0.0))), F.lit(0.0))).alias("unit"))
