"""Attributes: derived, cast, averaged, mapped, imported and edited."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.predicates import matched
from weftgraph.graph import Graph, unique_name
from weftgraph.operators.structure import connected_components
from weftgraph.operators.transforms import separate_by_attribute


def infer_attribute_type(df: DataFrame, column: str) -> str:
    """``bigint``, ``double`` or ``string``: the narrowest that holds all values; empty text counts as missing."""
    value = F.nullif(F.col(column).cast("string"), F.lit(""))
    row = df.agg(F.count(value), F.count(value.try_cast("bigint")), F.count(value.try_cast("double"))).first()
    return "string" if not row[0] or row[2] < row[0] else "double" if row[1] < row[0] else "bigint"


def retyped(df: DataFrame, column: str) -> DataFrame:
    kind = infer_attribute_type(df, column)
    value = F.nullif(F.col(column).cast("string"), F.lit(""))
    return df.withColumn(column, value if kind == "string" else value.try_cast(kind))


def java_template(template: str) -> str:
    r"""A template with ``\1`` groups as a Java replacement."""
    return re.sub(r"\\(\d+)", r"$\1", template.replace("$", "\\$"))


def synthesise_attribute(df: DataFrame, source: str, name: str, pattern: str = "(^.*$)", template: str = r"\1", infer: bool = True) -> DataFrame:
    """Where the pattern is found in ``source``: all its matches replaced by the template; elsewhere missing."""
    value = F.col(source).cast("string")
    made = df.withColumn(name, F.when(value.rlike(pattern), F.regexp_replace(value, pattern, java_template(template))))
    return retyped(made, name) if infer else made


def combine_attributes(df: DataFrame, first: str, second: str, name: str, template: str = r"\1 \2", infer: bool = True) -> DataFrame:
    r"""The template with ``\1`` and then ``\2`` replaced by two attributes; missing ones are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    made = df.withColumn(name, F.replace(F.replace(F.lit(template), F.lit("\\1"), text(first)), F.lit("\\2"), text(second)))
    return retyped(made, name) if infer else made


def boolean_attribute(df: DataFrame, name: str, condition: Column) -> DataFrame:
    return df.withColumn(name, F.when(matched(condition), "True").otherwise("False"))


def average_by_category(df: DataFrame, value: str, category: str) -> DataFrame:
    """``Mean <value> of <category>``: missing where the category is."""
    mean = F.avg(F.col(value).cast("double")).over(Window.partitionBy(category))
    return df.withColumn(f"Mean {value} of {category}", F.when(F.col(category).isNotNull(), mean))


def cast_attribute(df: DataFrame, source: str, name: str, kind: str) -> DataFrame:
    """A copy as ``Integer``, ``Float`` or ``String``; what does not convert becomes 0, 0.0 or empty."""
    to, default = {"Integer": ("bigint", 0), "Float": ("double", 0.0), "String": ("string", "")}[kind]
    value = F.col(source).try_cast(to)
    if kind == "Integer":
        value = F.coalesce(value, F.col(source).try_cast("double").try_cast("bigint"))
    return df.withColumn(name, F.coalesce(value, F.lit(default)))


def forward_merged_attribute(df: DataFrame, attribute: str, key: str = "id") -> DataFrame:
    """Tails take their head's value, missing or not; needs the column ``head``."""
    heads = df.where(F.col(key) == F.col("head")).select(F.col("head").alias("h_"), F.col(attribute).alias("value_"))
    return df.join(heads, F.col("head") == F.col("h_"), "left").withColumn(attribute, F.col("value_")).drop("h_", "value_").select(*df.columns)


def attribute_range(df: DataFrame, *attributes: str, by: str | None = None) -> DataFrame:
    """(attribute, low, high), for all rows or per value of ``by``."""
    long = df.select(*([by] if by else []), F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("x")) for a in attributes])).alias("s"))
    keys = [F.col(by)] if by else []
    return long.groupBy(*keys, F.col("s.attribute").alias("attribute")).agg(F.min("s.x").alias("low"), F.max("s.x").alias("high"))


def shared_values(df: DataFrame, attribute: str) -> DataFrame:
    """(value, count) of the present values."""
    return df.where(F.col(attribute).isNotNull()).groupBy(F.col(attribute).cast("string").alias("value")).agg(F.count("*").alias("count"))


def attribute_statistics(df: DataFrame, attribute: str, by: str | None = None) -> DataFrame:
    """n, low, high, mean, sum, population variance and deviation."""
    x = F.col(attribute).cast("double")
    return df.groupBy(*([by] if by else [])).agg(
        F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.sum(x).alias("sum"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("deviation")
    )


def map_to_unit(df: DataFrame, attribute: str, name: str, mode: str = "minmax", low: float | None = None, high: float | None = None, exponent: float = 1.0, invert: bool = False, by: str | None = None) -> DataFrame:
    """An attribute mapped to [0, 1] over its range, ``mean`` plus or minus the deviation (``stddev``), or ``low`` to ``high`` (``explicit``).

    Ranges are clamped to the data's, an empty one falls back to it, and of a single value 0 is made.
    """
    x = F.col(attribute).cast("double")
    stats = df.groupBy(*([by] if by else [])).agg(F.min(x).alias("lo_"), F.max(x).alias("hi_"), F.avg(x).alias("mean_"), F.stddev_pop(x).alias("dev_"))
    joined = df.join(stats.withColumnRenamed(by, "by_"), F.col(by).eqNullSafe(F.col("by_")), "left") if by else df.crossJoin(F.broadcast(stats))  # one row
    start, end = {"minmax": (F.col("lo_"), F.col("hi_")), "stddev": (F.col("mean_") - F.col("dev_"), F.col("mean_") + F.col("dev_")), "explicit": (F.lit(low).cast("double"), F.lit(high).cast("double"))}[mode]
    start, end = F.greatest(start, F.col("lo_")), F.least(end, F.col("hi_"))
    empty = start >= end
    start, end = F.when(empty, F.col("lo_")).otherwise(start), F.when(empty, F.col("hi_")).otherwise(end)
    unit = F.pow(F.coalesce(F.try_divide(F.least(F.greatest(x, start), end) - start, F.nullif(end - start, F.lit(0.0))), F.when(x.isNotNull(), F.lit(0.0))), F.lit(exponent))
    return joined.withColumn(name, 1 - unit if invert else unit).select(*df.columns, name)


def label_groups(graph: Graph, attribute: str) -> DataFrame:
    """(component, label, nodes): connected groups of nodes that share a value, with their size.

    ``members`` of a group can be any number, so they stay rows: see ``connected_components``.
    """
    found = connected_components(separate_by_attribute(graph, attribute)).nodes.where(F.col(attribute).isNotNull())
    return found.groupBy("component").agg(F.min(F.col(attribute).cast("string")).alias("label"), F.count("*").alias("nodes"))


def import_attributes(df: DataFrame, table: DataFrame, key: str, table_key: str, columns: list[str] | None = None, replace: bool = False, order: str | None = None) -> DataFrame:
    """Columns of a table by matching keys as text; the first row of a key (by ``order``, else all columns) counts.

    An existing column of the same type is replaced on request; otherwise the new name is made unique.
    """
    columns = columns or [c for c in table.columns if c != table_key]
    rest = F.struct(*[F.col(c) for c in columns])
    first = F.min_by(rest, order) if order else F.min(rest)
    firsts = table.where(F.col(table_key).isNotNull()).groupBy(F.col(table_key).cast("string").alias("k_")).agg(first.alias("row_"))
    joined = df.join(firsts, F.col(key).cast("string") == F.col("k_"), "left")
    for c in columns:
        same = replace and c in df.columns and df.schema[c].dataType == table.schema[c].dataType
        joined = joined.withColumn(c if same else unique_name(c, joined.columns), F.col("row_")[c])
    return joined.drop("k_", "row_")


def clone_attribute(df: DataFrame, attribute: str, name: str | None = None) -> DataFrame:
    name = unique_name(name or attribute, df.columns)
    return retyped(df.withColumn(name, F.col(attribute).cast("string")), name)


def remove_attributes(df: DataFrame, *attributes: str, fixed: tuple[str, ...] = ("id", "name", "edge_id", "src", "dst")) -> DataFrame:
    """Without the given columns; those that make up the graph stay."""
    return df.drop(*[a for a in attributes if a not in fixed])


CONVERSIONS = {"bigint": {"bigint", "double", "string"}, "int": {"int", "bigint", "double", "string"}, "double": {"double", "string"}, "string": {"string"}}


def edit_attribute(df: DataFrame, attribute: str, edits: DataFrame, key: str = "id", to: str | None = None) -> DataFrame:
    """Values of ``edits`` (key, value) set in ``attribute``; integers may become anything, floats only text."""
    had = df.schema[attribute].dataType.simpleString()
    to = to or had
    if to not in CONVERSIONS.get(had, {had}):
        raise ValueError(f"{had} does not convert to {to}")
    new = edits.groupBy(F.col(edits.columns[0]).alias("k_")).agg(F.max(F.col(edits.columns[1])).cast(to).alias("new_"), F.lit(True).alias("set_"))
    value = F.when(F.col("set_"), F.col("new_")).otherwise(F.col(attribute).cast(to))
    return df.join(new, F.col(key) == F.col("k_"), "left").withColumn(attribute, value).select(*df.columns)
