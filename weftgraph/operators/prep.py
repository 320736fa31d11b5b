"""Looking at tables before they become graphs: types, duplicates, rectangles, keys, size estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def infer_column_types(df: DataFrame) -> DataFrame:
    """(column, type): unknown, int, float or string, by the values of each column as text; one pass."""
    counts = []
    for k, c in enumerate(df.columns):
        value = F.nullif(F.col(c).cast("string"), F.lit(""))
        counts += [F.count(value).alias(f"n{k}"), F.count(value.try_cast("bigint")).alias(f"i{k}"), F.count(value.try_cast("double")).alias(f"f{k}")]
    totals = df.agg(*counts)
    rows = [F.struct(F.lit(c).alias("column"), F.when(F.col(f"n{k}") == 0, "unknown").when(F.col(f"i{k}") == F.col(f"n{k}"), "int").when(F.col(f"f{k}") == F.col(f"n{k}"), "float").otherwise("string").alias("type")) for k, c in enumerate(df.columns)]
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def column_duplicates(df: DataFrame) -> DataFrame:
    """(column, duplicates): whether present values repeat.  Counts by value, column by column."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns])).alias("s")).select("s.*")
    counted = cells.groupBy("column", "v").agg(F.count("v").alias("n"))
    return counted.groupBy("column").agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("duplicates"))


def _cells(df: DataFrame, key: str):
    """The present cells of a row as texts, without the key; an empty cell counts as missing."""
    held = F.array(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in df.columns if c != key])
    return F.filter(held, lambda x: x.isNotNull())


def infer_row_types(df: DataFrame, key: str) -> DataFrame:
    """(key, type): unknown, int, float or string, by the cells of each row; no row leaves its task."""
    cells = _cells(df, key)
    every = lambda kind: F.forall(cells, lambda x: x.try_cast(kind).isNotNull())
    return df.select(key, F.when(F.size(cells) == 0, "unknown").when(every("bigint"), "int").when(every("double"), "float").otherwise("string").alias("type"))


def row_duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, duplicates): whether present cells of a row repeat; no row leaves its task."""
    cells = _cells(df, key)
    return df.select(key, (F.size(cells) > F.size(F.array_distinct(cells))).alias("duplicates"))


def find_numeric_rect(df: DataFrame) -> list[str]:
    """The longest run of numeric columns at the right edge: the data, all before it being annotations."""
    types = {r["column"]: r["type"] for r in infer_column_types(df).collect()}
    data: list[str] = []
    for c in reversed(df.columns):
        if types[c] not in ("int", "float"):
            break
        data.insert(0, c)
    return data


def transpose(m: DataFrame) -> DataFrame:
    """Rows and columns of a long-form matrix swapped."""
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "x")


def match_percentage(df: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    """(percent): how much of the distinct reference values the column holds, rounded down."""
    wanted = reference.select(F.col(reference.columns[0]).cast("string").alias("v")).where("v is not null").distinct()
    held = df.select(F.col(column).cast("string").alias("h")).where("h is not null").distinct()
    return wanted.join(held, F.col("v") == F.col("h"), "left").agg(F.coalesce(F.floor(F.try_divide(100 * F.count("h"), F.count("*"))), F.lit(0)).cast("long").alias("percent"))


def detect_join_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """(attribute, column, percent): the pair of text or integer columns in which most of the left's distinct values are found.

    Ties go to the earlier column and then the shorter attribute name.
    """
    usable = lambda df: [c for c, t in df.dtypes if t in ("string", "int", "bigint")]
    long = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(k).alias(f"{name}_at"), F.lit(c).alias(name), F.col(c).cast("string").alias("v")) for k, c in enumerate(usable(df))])).alias("s")).select("s.*").where("v is not null").distinct()
    a, b = long(left, "attribute"), long(right, "column")
    sizes = a.groupBy("attribute").agg(F.count("*").alias("n"))
    met = a.join(b, "v").groupBy("attribute", "column", "column_at").agg(F.count("*").alias("met")).join(sizes, "attribute")
    scored = met.withColumn("percent", F.floor(100 * F.col("met") / F.col("n")).cast("long"))
    return scored.orderBy(F.desc("percent"), "column_at", F.length("attribute"), "attribute").limit(1).select("attribute", "column", "percent")


def graph_size_curve_threshold(edges: DataFrame, steps: int = 100) -> DataFrame:
    """(step, cut_off, edges, nodes, unique_edges) of an edge list (src, dst, weight) for evenly spaced cut-offs of |weight|, from the largest down.

    ``unique_edges`` counts the pairs of ends, whichever way and however often an edge runs.
    """
    weight = F.abs(F.col("weight").cast("double"))
    span = edges.agg(F.max(weight).alias("hi"), F.min(weight).alias("lo"))
    step = F.least(F.floor(F.coalesce(F.try_divide((F.col("hi") - F.col("w")) * steps, F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), F.lit(0.0))), F.lit(steps - 1)).cast("int")
    marked = edges.select("src", "dst", weight.alias("w")).crossJoin(F.broadcast(span)).withColumn("step", step)  # one row
    ends = marked.select(F.explode(F.array("src", "dst")).alias("node"), "step").groupBy("node").agg(F.min("step").alias("step"))
    pairs = marked.groupBy(F.least("src", "dst").alias("a_"), F.greatest("src", "dst").alias("b_")).agg(F.min("step").alias("step"))
    grid = span.select("hi", "lo", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    at = lambda df, name: df.groupBy(F.col("step").alias(f"{name}_s")).agg(F.count("*").alias(name))
    counted = grid.join(at(marked, "e"), F.col("step") == F.col("e_s"), "left").join(at(ends, "n"), F.col("step") == F.col("n_s"), "left").join(at(pairs, "u"), F.col("step") == F.col("u_s"), "left")
    order = Window.orderBy("step")  # a row for each step
    running = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(order).cast("long")
    return counted.select("step", (F.col("hi") - (F.col("hi") - F.col("lo")) * (F.col("step") + 1) / steps).alias("cut_off"), running(F.col("e")).alias("edges"), running(F.col("n")).alias("nodes"), running(F.col("u")).alias("unique_edges"))


def graph_size_curve_knn(edges: DataFrame, most: int = 100) -> DataFrame:
    """(k, edges): how many edges are among the first k of either end by |weight|."""
    seen = edges.select("edge_id", F.abs("weight").alias("w"), F.explode(F.array("src", "dst")).alias("node"))
    ranked = seen.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), "edge_id")))
    # a limit of the rank is applied in every task before the exchange, so a hub's edges don't all come to one
    enters = ranked.where(F.col("k") <= most).groupBy("edge_id").agg(F.min("k").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return enters.select("k", F.sum("n").over(Window.orderBy("k")).cast("long").alias("edges"))  # at most ``most`` rows


def sample_rows(df: DataFrame, n: int, key: str = "id", seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, by a hash of the key and a seed; the same rows each time."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
