"""Search, selections, bookmarks and orderings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.predicates import matched, quoted
from weftgraph.graph import Graph
from weftgraph.operators.structure import expand_selection


def search_pattern(term: str, regex: bool = False, whole_word: bool = False, match_case: bool = False, exact: bool = False) -> str:
    """The regular expression of a search; an exact one heeds case always."""
    pattern = term if regex and not exact else quoted(term)
    if exact:
        return f"^{pattern}$"
    if whole_word:
        pattern = f"\\b(?:{pattern})\\b"
    return pattern if match_case else f"(?i){pattern}"


def find_nodes(graph: Graph, term: str, attributes: tuple[str, ...] = (), **options: bool) -> DataFrame:
    """(id) of the nodes with a hit in one of the attributes (without any: the name), with all of their merge sets."""
    pattern = search_pattern(term, **options)
    hit = reduce(lambda a, b: a | b, [matched(F.col(c).cast("string").rlike(pattern)) for c in attributes or ("name",)])
    found = graph.nodes.where(hit).select("id")
    return expand_selection(graph, found) if "head" in graph.nodes.columns else found


def _masked(graph: Graph, ids: DataFrame, mask: DataFrame | None) -> DataFrame:
    ids = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    ids = expand_selection(graph, ids) if "head" in graph.nodes.columns else ids
    return ids if mask is None else ids.join(mask.select(F.col(mask.columns[0]).alias("m_")).distinct(), F.col("id") == F.col("m_"), "left_semi")


def select(graph: Graph, selection: DataFrame, ids: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """The selection with more nodes."""
    return selection.select(F.col(selection.columns[0]).alias("id")).union(_masked(graph, ids, mask)).distinct()


def deselect(graph: Graph, selection: DataFrame, ids: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    gone = _masked(graph, ids, mask).toDF("g_")
    return selection.select(F.col(selection.columns[0]).alias("id")).distinct().join(gone, F.col("id") == F.col("g_"), "left_anti")


def select_all(graph: Graph, mask: DataFrame | None = None) -> DataFrame:
    return _masked(graph, graph.nodes.select("id"), mask)


def invert(graph: Graph, selection: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """All nodes (of the mask) that are not selected."""
    chosen = selection.select(F.col(selection.columns[0]).alias("s_")).distinct()
    return select_all(graph, mask).join(chosen, F.col("id") == F.col("s_"), "left_anti")


def bookmark(bookmarks: DataFrame | None, name: str, ids: DataFrame) -> DataFrame:
    """The table (name, node) with one more set; an older set of that name goes."""
    new = ids.select(F.lit(name).alias("name"), F.col(ids.columns[0]).alias("node")).distinct()
    return new if bookmarks is None else bookmarks.where(F.col("name") != name).unionByName(new)


def natural_key(text: Column, case_sensitive: bool = True) -> Column:
    """A sort key under which runs of digits order as numbers of any length."""
    value = text if case_sensitive else F.lower(text)
    parts = F.regexp_extract_all(value, F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def part(p: Column) -> Column:
        number = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(number).cast("string"), 10, "0"), number)).otherwise(p)

    return F.array_join(F.transform(parts, part), "")


def natural_sort(df: DataFrame, column: str, ascending: bool = True, case_sensitive: bool = True) -> DataFrame:
    key = natural_key(F.col(column).cast("string"), case_sensitive)
    return df.orderBy(key.asc() if ascending else key.desc(), column)


def sort_filter_table(df: DataFrame, condition: Column | None = None, by: str | None = None, ascending: bool = True) -> DataFrame:
    out = df if condition is None else df.where(matched(condition))
    return out if by is None else out.orderBy(F.col(by).asc() if ascending else F.col(by).desc())
