"""Enrichment: do the values of two attributes meet more often than by chance?"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


#: Terms whose log, with the largest term as 0, is below this are zero as doubles.
_VANISHED = -745.0
#: Terms that are worked out together.
_BLOCK = 1 << 14


def _outwards(first: int, last: int, row: int, column: int, n: int, seen: float, tie: float) -> tuple[float, float]:
    """(all, as rare) of the terms after ``first`` up to ``last`` on one side, the term of ``first`` being 1.

    Each term is the one before times a ratio of four whole numbers, so no factorial is needed; blocks
    are taken until the terms vanish, some 40 standard deviations away at most.
    """
    total = rare = at = 0.0
    step = 1 if last >= first else -1
    for start in range(first, last, step * _BLOCK):
        k = np.arange(start, (min if step > 0 else max)(last, start + step * _BLOCK), step, dtype=np.float64)
        up = k if step > 0 else k - 1
        ratio = np.log(row - up) + np.log(column - up) - np.log(up + 1) - np.log(n - row - column + up + 1)
        logs = at + np.cumsum(ratio * step)
        at = float(logs[-1])
        terms = np.exp(logs)
        total += terms.sum()
        rare += terms[logs <= seen + tie].sum()
        if at < _VANISHED:
            break
    return float(total), float(rare)


def _log_term(both: int, mode: int, row: int, column: int, n: int) -> float:
    """Log of the observed term over that of the mode; minus infinity once it is zero as a double."""
    at, step = 0.0, 1 if both >= mode else -1
    for start in range(mode, both, step * _BLOCK):
        k = np.arange(start, (min if step > 0 else max)(both, start + step * _BLOCK), step, dtype=np.float64)
        up = k if step > 0 else k - 1
        at += step * float((np.log(row - up) + np.log(column - up) - np.log(up + 1) - np.log(n - row - column + up + 1)).sum())
        if at < _VANISHED:
            return -math.inf
    return at


def _fisher(both: int, row: int, column: int, n: int, tie: float = 1e-9) -> float:
    low, high = max(0, row + column - n), min(row, column)
    mode = min(max((row + 1) * (column + 1) // (n + 2), low), high)
    seen = _log_term(both, mode, row, column, n)
    if seen == -math.inf:
        return 0.0
    sides = [_outwards(mode, end, row, column, n, seen, tie) for end in (low, high)]
    own = 1.0 if seen + tie >= 0 else 0.0
    return min(1.0, (own + sum(rare for _, rare in sides)) / (1.0 + sum(total for total, _ in sides)))


@F.pandas_udf(DoubleType())
def fisher_exact(both: pd.Series, row: pd.Series, column: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p: the sum of the hypergeometric probabilities that are at most that of the table.

    The terms run outwards from the likeliest table by ratios of neighbours, in blocks of bounded size
    and only as far as they are not zero, so neither memory nor time grows with the counts themselves.
    A null count gives null.
    """
    known = lambda r: not any(pd.isna(x) for x in r)
    return pd.Series([_fisher(*map(int, r)) if known(r) else None for r in zip(both, row, column, n)], dtype=float)


def enrichment(df: DataFrame, a: str, b: str) -> DataFrame:
    """For each pair of present values of two attributes: observed and expected overlap, representation, deviation, p and Bonferroni p.

    Pairs without overlap are there too.  All rows count towards n, also those without a value.
    ``deviation`` is ``sqrt(p (1 - p) c)`` of drawing the c rows of the second value with chance p of
    the first.
    """
    present = lambda c: df.where(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).select(F.col(c).cast("string").alias(c))
    rows = present(a).groupBy(F.col(a).alias("value_a")).agg(F.count("*").alias("r"))
    columns = present(b).groupBy(F.col(b).alias("value_b")).agg(F.count("*").alias("c"))
    met = df.groupBy(F.col(a).cast("string").alias("a_"), F.col(b).cast("string").alias("b_")).agg(F.count("*").alias("met"))
    totals = df.agg(F.count("*").alias("n")).crossJoin(columns.agg(F.count("*").alias("kinds")))  # one row
    # the result has a row for each pair of values
    pairs = rows.crossJoin(columns).crossJoin(F.broadcast(totals)).join(met, (F.col("value_a") == F.col("a_")) & (F.col("value_b") == F.col("b_")), "left")
    observed, share = F.coalesce("met", F.lit(0)).cast("long"), F.col("r") / F.col("n")
    shown = pairs.select("value_a", "value_b", observed.alias("observed"), (share * F.col("c")).alias("expected"), F.sqrt(share * (1 - share) * F.col("c")).alias("deviation"), fisher_exact(observed, "r", "c", "n").alias("p"), "kinds")
    return shown.select("value_a", "value_b", "observed", "expected", (F.col("observed") / F.col("expected")).alias("representation"), "deviation", "p", F.least(F.col("p") * F.col("kinds"), F.lit(1.0)).alias("bonferroni"))


def enriched_only(result: DataFrame, most: float = 0.05, by: str = "bonferroni") -> DataFrame:
    """The pairs that meet too often, with a Bonferroni p of at most ``most``, sorted."""
    return result.where((F.col("representation") > 1) & (F.col("bonferroni") <= most)).orderBy(by, "value_a", "value_b")
