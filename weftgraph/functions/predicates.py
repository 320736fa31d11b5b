"""Conditions over attributes, as Columns.  A condition on a missing value is no match."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph


def _column(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def matched(condition: Column) -> Column:
    """NULL counts as false; use it wherever rows are chosen by a condition or its opposite."""
    return F.coalesce(condition, F.lit(False))


def equals(attribute: Column, value: object) -> Column:
    return matched(attribute == _column(value))


def differs(attribute: Column, value: object) -> Column:
    return matched(attribute != _column(value))


def _ordered(condition: Column, *sides: Column) -> Column:
    """Spark puts NaN above all numbers; here it compares with nothing."""
    for side in sides:
        condition = condition & ~F.isnan(side.cast("double"))
    return matched(condition)


def less(attribute: Column, value: object) -> Column:
    return _ordered(attribute < _column(value), attribute, _column(value))


def greater(attribute: Column, value: object) -> Column:
    return _ordered(attribute > _column(value), attribute, _column(value))


def at_most(attribute: Column, value: object) -> Column:
    return _ordered(attribute <= _column(value), attribute, _column(value))


def at_least(attribute: Column, value: object) -> Column:
    return _ordered(attribute >= _column(value), attribute, _column(value))


def includes(attribute: Column, text: object) -> Column:
    return matched(F.contains(attribute, _column(text)))


def excludes(attribute: Column, text: object) -> Column:
    return matched(~F.contains(attribute, _column(text)))


def starts(attribute: Column, text: object) -> Column:
    return matched(F.startswith(attribute, _column(text)))


def ends(attribute: Column, text: object) -> Column:
    return matched(F.endswith(attribute, _column(text)))


def matches(attribute: Column, pattern: str, case_sensitive: bool = True) -> Column:
    """A regular expression (Java dialect) found anywhere in the text."""
    return matched(attribute.rlike(pattern if case_sensitive else f"(?i){pattern}"))


def has_value(attribute: Column) -> Column:
    return attribute.isNotNull()


def all_of(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & matched(c)
    return out


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | matched(c)
    return out


def with_end_attributes(graph: Graph, *names: str) -> DataFrame:
    """Edges with ``source.X`` and ``target.X`` for the node attributes named, for conditions on edges."""
    edges = graph.edges
    for prefix, end in (("source", "src"), ("target", "dst")):
        side = graph.nodes.select(F.col("id").alias(f"{prefix}_id_"), *[F.col(n).alias(f"{prefix}.{n}") for n in names])
        edges = edges.join(side, F.col(end) == F.col(f"{prefix}_id_"), "left").drop(f"{prefix}_id_")
    return edges


def source(name: str) -> Column:
    return F.col(f"`source.{name}`")


def target(name: str) -> Column:
    return F.col(f"`target.{name}`")


def quoted(text: str) -> str:
    """``text`` as a regular expression that matches it literally."""
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", text)
