"""The registered queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph import fixtures as X
from weftgraph.functions import predicates as P
from weftgraph.graph import Graph
from weftgraph.operators import attributes as A
from weftgraph.operators import cluster as L
from weftgraph.operators import enrich as E
from weftgraph.operators import matrix as M
from weftgraph.operators import metrics as K
from weftgraph.operators import prep as R
from weftgraph.operators import select as S
from weftgraph.operators import similarity as C
from weftgraph.operators import structure as G
from weftgraph.operators import transforms as T
from weftgraph.plans import batch
from weftgraph.plans.iterate import shared_path
from weftgraph.plans.pipeline import Pipeline, step
from weftgraph.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The supply graph in SQL: nodes n and edges e.
SUPPLY = """WITH n AS (SELECT row_number() OVER (ORDER BY name) - 1 AS id, * FROM (
  SELECT 'P' || p_partkey AS name, 'part' AS kind, p_brand AS brand, p_retailprice AS worth FROM part
  UNION ALL SELECT 'S' || s_suppkey, 'supplier', NULL, s_acctbal FROM supplier)),
e AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, * FROM (
  SELECT a.id AS src, b.id AS dst, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS price, count(*) AS lines
  FROM lineitem JOIN n a ON a.name = 'P' || l_partkey JOIN n b ON b.name = 'S' || l_suppkey GROUP BY 1, 2)),
inc AS (SELECT edge_id, dst AS node, src AS other, 'in' AS side, quantity, price FROM e UNION ALL SELECT edge_id, src, dst, 'out', quantity, price FROM e)
"""
#: The forest of regions, nations, customers and suppliers.
GEO = """WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY name) - 1 AS id, * FROM (
  SELECT 'R' || r_regionkey AS name, 'region' AS kind, r_name AS label, CAST(NULL AS DOUBLE) AS balance FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'nation', n_name, NULL FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'customer', c_mktsegment, c_acctbal FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'supplier', NULL, s_acctbal FROM supplier)),
e AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, * FROM (SELECT a.id AS src, b.id AS dst FROM (
  SELECT 'N' || n_nationkey AS f, 'R' || n_regionkey AS t FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier) JOIN n a ON a.name = f JOIN n b ON b.name = t)),
up AS (SELECT id, id AS top FROM n WHERE kind = 'region' UNION ALL SELECT e.src, up.top FROM e JOIN up ON e.dst = up.id),
comp AS (SELECT up.id, m.component FROM up JOIN (SELECT top, min(id) AS component FROM up GROUP BY top) m USING (top))
"""
SPEND = """WITH m AS (SELECT c_custkey AS row, p.col, x FROM customer CROSS JOIN (VALUES ('1-URGENT', 0), ('2-HIGH', 1), ('3-MEDIUM', 2), ('4-NOT SPECIFIED', 3), ('5-LOW', 4)) p(name, col)
LEFT JOIN (SELECT o_custkey, o_orderpriority, round(sum(o_totalprice), 2) AS x FROM orders GROUP BY 1, 2) ON o_custkey = c_custkey AND o_orderpriority = p.name)
"""
FULL = SPEND + ", f AS (SELECT row, col, coalesce(x, 0.0) AS x FROM m)\n"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return register


def on_graph(make: Callable[[SparkSession, str], Graph], name: str, run: Callable[[Graph], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(lambda spark, sf_dir: run(make(spark, sf_dir)))


def on_matrix(name: str, run: Callable[[DataFrame], DataFrame], x: str | None, digits: int = 6, filled: bool = False) -> None:
    """A matrix operator that gives cells: SQL for the new ``x`` over m, or over f with missing cells as 0."""

    def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = X.spend(spark, sf_dir)
        return run(M.impute_constant(m, 0.0) if filled else m).select("row", "col", F.round("x", digits).alias("x"))

    query(name, None if x is None else f"{FULL if filled else SPEND}{x if x.startswith('SELECT') else f'SELECT row, col, round({x}, {digits}) AS x FROM {"f" if filled else "m"}'}")(cells)


EDGES, NODES = "edge_id, src, dst, quantity, lines", "id, name"
edges = lambda g: g.edges.select("edge_id", "src", "dst", "quantity", "lines")
both = lambda g: G.graph_diff(Graph(g.nodes.limit(0), g.edges.limit(0)), g).select("element", "id")
BOTH = "SELECT 'node' AS element, id FROM kn UNION ALL SELECT 'edge', edge_id FROM ke"


@query("flagship_supply_degrees", SUPPLY + "SELECT n.id, name, count(edge_id) AS degree FROM n LEFT JOIN (SELECT inc.* FROM inc WHERE quantity >= 50) i ON i.node = n.id GROUP BY ALL ORDER BY degree DESC, id LIMIT 20")
def flagship_supply_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a quantity of 50 or more, and the 20 nodes with most of them."""
    graph = T.keep_edges_where(X.supply(spark, sf_dir), P.at_least(F.col("quantity"), 50))
    ranked = G.degrees(graph).orderBy(F.desc("degree"), "id").limit(20)
    return ranked.join(graph.nodes.select("id", "name"), "id").select("id", "name", "degree")


# sources
on_graph(X.supply, "s9_graph_from_tables", edges, SUPPLY + f"SELECT {EDGES} FROM e")
query("s1_read_pairwise", """WITH p AS (SELECT 'O' || o_orderkey AS s, 'C' || o_custkey AS t, o_orderpriority AS pr, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders),
n AS (SELECT row_number() OVER (ORDER BY name) - 1 AS id, name FROM (SELECT s AS name FROM p UNION SELECT t FROM p))
SELECT a.id AS src, b.id AS dst, pr AS priority FROM p JOIN n a ON a.name = s JOIN n b ON b.name = t""")(
    lambda spark, d: readers.read_pairwise(X.table(spark, d, "orders").select(X.key("O", "o_orderkey").alias("s"), X.key("C", "o_custkey").alias("t"), F.col("o_orderpriority").alias("priority")), "s", "t", ("priority",)).edges.select("src", "dst", "priority")
)
query("s2_read_edge_list", """SELECT src, dst, w AS "Edge Weight", abs(w) AS "Absolute Edge Weight" FROM (SELECT l_partkey AS src, l_suppkey AS dst, l_quantity - 25 AS w,
row_number() OVER (PARTITION BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY abs(l_quantity - 25) DESC, l_quantity DESC, l_partkey) AS r FROM lineitem WHERE abs(l_quantity - 25) > 5) WHERE r = 1""")(
    lambda spark, d: readers.read_edge_list(X.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_quantity") - 25).cast("string").alias("w")), 5.0, True)
)
query("s3_read_adjacency_matrix", SPEND + """SELECT p.name AS source, 'C' || row AS target, x AS "Edge Weight" FROM m JOIN (VALUES ('1-URGENT', 0), ('2-HIGH', 1), ('3-MEDIUM', 2), ('4-NOT SPECIFIED', 3), ('5-LOW', 4)) p(name, col) USING (col) WHERE abs(x) > 100000""")(
    lambda spark, d: readers.read_adjacency_matrix(X.spend(spark, d).groupBy(X.key("C", "row").alias("name")).pivot("col", [0, 1, 2, 3, 4]).agg(F.max("x")).toDF("name", *X.PRIORITIES), "name", 100000.0)
)



def written(spark: SparkSession, df: DataFrame, write: Callable[[DataFrame, str], None]) -> str:
    """The path of a new file of these rows in the shared folder."""
    path = shared_path(spark, "written")
    write(df, path)
    return path


@query("s4_read_delimited", "SELECT c_custkey::VARCHAR AS key, nullif(c_name, '') AS name, 'of \"' || c_nationkey || '\", ' || c_mktsegment AS note, c_acctbal::DOUBLE AS balance FROM customer")
def s4_read_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as delimited text, with quotes and delimiters inside cells, and read again."""
    note = F.concat(F.lit('of "'), F.col("c_nationkey").cast("string"), F.lit('", '), F.col("c_mktsegment"))
    rows = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), note.alias("note"), F.col("c_acctbal").alias("balance"))
    path = written(spark, rows, lambda df, p: df.write.csv(p, header=True, quote='"', escape='"'))
    return readers.read_delimited(spark, path).select("key", "name", "note", F.col("balance").cast("double").alias("balance"))


@query("s8_read_graph_parquet", SUPPLY + f"SELECT {EDGES} FROM e")
def s8_read_graph_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supply graph saved as Parquet and read again."""
    path = shared_path(spark, "graph")
    writers.write_graph_parquet(X.supply(spark, sf_dir), path, {"made of": "lineitem"})
    return edges(readers.read_graph_parquet(spark, path)[0])


@query("k3_write_graph_parquet", SUPPLY + "SELECT id, name, kind, worth FROM n")
def k3_write_graph_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the saved supply graph."""
    path = shared_path(spark, "graph")
    writers.write_graph_parquet(X.supply(spark, sf_dir), path)
    return spark.read.parquet(f"{path}/nodes").select("id", "name", "kind", "worth")


# preparation
query("p1_infer_column_types", """SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']) AS "column", unnest(['int', 'int', 'string', 'float', 'string']) AS type""")(
    lambda spark, d: R.infer_column_types(X.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
)
query("p2_column_duplicates", "SELECT 'c_custkey' AS \"column\", count(c_custkey) > count(DISTINCT c_custkey) AS duplicates FROM customer UNION ALL SELECT 'c_nationkey', count(c_nationkey) > count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', count(c_acctbal) > count(DISTINCT c_acctbal) FROM customer")(
    lambda spark, d: R.column_duplicates(X.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"))
)
MIXED = "SELECT p_partkey, p_size::VARCHAR AS a, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_retailprice::VARCHAR ELSE '' END AS b, '' AS c, nullif(p_size % 5, 0)::VARCHAR AS d, p_retailprice::VARCHAR AS e FROM part"
mixed = lambda spark, d: X.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("a"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.col("p_retailprice").cast("string")).otherwise("").alias("b"), F.lit("").alias("c"), F.nullif(F.col("p_size") % 5, F.lit(0)).cast("string").alias("d"), F.col("p_retailprice").cast("string").alias("e"))
TYPED = "CASE WHEN {n} = 0 THEN 'unknown' WHEN {i} = {n} THEN 'int' WHEN {f} = {n} THEN 'float' ELSE 'string' END AS type"
LONG_MIXED = f"WITH t AS ({MIXED}), v AS (" + " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS \"column\", nullif({c}, '') AS v FROM t" for c in "abcde") + ") "
BY_VALUE = TYPED.format(n="count(v)", i="count(*) FILTER (regexp_full_match(v, '[0-9]+'))", f="count(*) FILTER (regexp_full_match(v, '[0-9]+([.][0-9]+)?'))")
query("p1_mixed_column_types", LONG_MIXED + f'SELECT "column", {BY_VALUE} FROM v GROUP BY 1')(lambda spark, d: R.infer_column_types(mixed(spark, d).drop("p_partkey")))
query("p1_infer_row_types", LONG_MIXED + f"SELECT p_partkey, {BY_VALUE} FROM v WHERE \"column\" IN ('a', 'b', 'c') GROUP BY 1")(lambda spark, d: R.infer_row_types(mixed(spark, d).select("p_partkey", "a", "b", "c"), "p_partkey"))
query("p2_row_duplicates", LONG_MIXED + "SELECT p_partkey, count(v) > count(DISTINCT v) AS duplicates FROM v GROUP BY 1")(lambda spark, d: R.row_duplicates(mixed(spark, d), "p_partkey"))
query("p3_find_numeric_rect", "SELECT 'p_size' AS name, 0 AS place, max(p_size)::DOUBLE AS high FROM part UNION ALL SELECT 'p_retailprice', 1, max(p_retailprice) FROM part")(
    lambda spark, d: (lambda part: (lambda cols: part.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in cols]))).groupBy("col.name", F.col("pos").alias("place")).agg(F.max("col.x").alias("high")))(R.find_numeric_rect(part)))(X.table(spark, d, "part"))
)
query("p4_transpose", SPEND + "SELECT col AS row, row AS col, x FROM m")(lambda spark, d: R.transpose(X.spend(spark, d)))
query("p5_match_percentage", "SELECT CAST(floor(100 * count(DISTINCT o_custkey) / (SELECT count(*) FROM customer)) AS BIGINT) AS percent FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")(
    lambda spark, d: R.match_percentage(X.table(spark, d, "orders"), "o_custkey", X.table(spark, d, "customer").select("c_custkey"))
)
query("p6_detect_join_key", "SELECT 'c_nationkey' AS attribute, 'n_nationkey' AS \"column\", CAST(floor(100 * count(DISTINCT c_nationkey) FILTER (c_nationkey IN (SELECT n_nationkey FROM nation)) / count(DISTINCT c_nationkey)) AS BIGINT) AS percent FROM customer")(
    lambda spark, d: R.detect_join_key(X.table(spark, d, "customer").select("c_name", "c_nationkey", "c_mktsegment"), X.table(spark, d, "nation").select("n_nationkey", "n_name"))
)
query("p7_graph_size_curve_threshold", SUPPLY + """, w AS (SELECT edge_id, src, dst, quantity AS w, (SELECT max(quantity) FROM e) AS hi, (SELECT min(quantity) FROM e) AS lo FROM e),
b AS (SELECT *, least(floor((hi - w) * 100 / (hi - lo)), 99) AS step FROM w), nn AS (SELECT node, min(step) AS step FROM (SELECT src AS node, step FROM b UNION ALL SELECT dst, step FROM b) GROUP BY node)
SELECT g.s::INT AS step, (SELECT count(*) FROM b WHERE step <= g.s) AS edges, (SELECT count(*) FROM nn WHERE step <= g.s) AS nodes FROM range(100) g(s)""")(
    lambda spark, d: R.graph_size_curve_threshold(X.supply(spark, d).edges.withColumnRenamed("quantity", "weight")).select("step", "edges", "nodes")
)
query("p7_graph_size_curve_of_lines", """WITH w AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, l_quantity::DOUBLE AS w, max(l_quantity::DOUBLE) OVER () AS hi, min(l_quantity::DOUBLE) OVER () AS lo FROM lineitem),
b AS (SELECT *, least(floor((hi - w) * 100 / (hi - lo)), 99) AS step FROM w), nn AS (SELECT node, min(step) AS step FROM (SELECT src AS node, step FROM b UNION ALL SELECT dst, step FROM b) GROUP BY node), u AS (SELECT src, dst, min(step) AS step FROM b GROUP BY 1, 2)
SELECT g.s::INT AS step, (SELECT count(*) FROM b WHERE step <= g.s) AS edges, (SELECT count(*) FROM nn WHERE step <= g.s) AS nodes, (SELECT count(*) FROM u WHERE step <= g.s) AS unique_edges FROM range(100) g(s)""")(
    lambda spark, d: R.graph_size_curve_threshold(X.table(spark, d, "lineitem").select(X.key("P", "l_partkey").alias("src"), X.key("S", "l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"))).select("step", "edges", "nodes", "unique_edges")
)
query("p8_graph_size_curve_knn", SUPPLY + """, k AS (SELECT edge_id, min(r) AS k FROM (SELECT edge_id, row_number() OVER (PARTITION BY node ORDER BY quantity DESC, edge_id) AS r FROM inc) GROUP BY 1)
SELECT k::INT AS k, CAST(sum(count(*)) OVER (ORDER BY k) AS BIGINT) AS edges FROM k WHERE k <= 100 GROUP BY k""")(
    lambda spark, d: R.graph_size_curve_knn(X.supply(spark, d).edges.withColumnRenamed("quantity", "weight"))
)
query("p9_sample_rows", "SELECT c_custkey FROM customer ORDER BY md5(c_custkey || '|7'), c_custkey LIMIT 100")(lambda spark, d: R.sample_rows(X.table(spark, d, "customer"), 100, "c_custkey", 7).select("c_custkey"))

# matrices
on_matrix("m1_impute_constant", lambda m: M.impute_constant(m, 7.5), "coalesce(x, 7.5)")
on_matrix("m2_impute_column_average", M.impute_column_average, "coalesce(x, avg(x) OVER (PARTITION BY col), 0)", 2)
on_matrix("m3_impute_row_interpolation", M.impute_row_interpolation, """SELECT row, col, round(coalesce(x, a + (b - a) * (col - ca) / (cb - ca), a, b, 0), 4) AS x FROM (SELECT *,
last_value(x IGNORE NULLS) OVER l AS a, last_value(CASE WHEN x IS NOT NULL THEN col END IGNORE NULLS) OVER l AS ca, first_value(x IGNORE NULLS) OVER r AS b, first_value(CASE WHEN x IS NOT NULL THEN col END IGNORE NULLS) OVER r AS cb FROM m
WINDOW l AS (PARTITION BY row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), r AS (PARTITION BY row ORDER BY col ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", 4)
on_matrix("m4_clip_constant", lambda m: M.clip_constant(m, 500000), "CASE WHEN x IS NOT NULL THEN least(x, 500000) END")
on_matrix("m5_clip_winsorize", lambda m: M.clip_winsorize(m, 75), "SELECT row, col, round(CASE WHEN x IS NOT NULL THEN least(x, t) END, 6) AS x FROM m LEFT JOIN (SELECT row, list_sort(list(x))[floor((count(x) - 1) * 75 / 100)::INT + 1] AS t FROM m WHERE x IS NOT NULL GROUP BY row) USING (row)")
on_matrix("m6_scale_log2", lambda m: M.scale_log(m, 2), "log2(x + (SELECT min(x) FILTER (x > 0) * 0.5 FROM m))")
on_matrix("m6_scale_log10", lambda m: M.scale_log(m, 10), "log10(x + (SELECT min(x) FILTER (x > 0) * 0.5 FROM m))")
on_matrix("m7_scale_antilog2", lambda m: M.scale_antilog(m.withColumn("x", F.col("x") / 100000), 2), "pow(2, x / 100000)", 4)
on_matrix("m8_scale_arcsin", lambda m: M.scale_arcsin(m.withColumn("x", F.col("x") / 10000000)), "asin(x / 10000000)")
on_matrix("m9_normalise_minmax", M.normalise_minmax, "(x - min(x) OVER c) / (max(x) OVER c - min(x) OVER c)", filled=True)
on_matrix("m10_normalise_mean", M.normalise_mean, "(x - avg(x) OVER c) / (max(x) OVER c - min(x) OVER c)", filled=True)
on_matrix("m11_normalise_standardise", M.normalise_standardise, "(x - avg(x) OVER c) / stddev_pop(x) OVER c", filled=True)
on_matrix("m12_normalise_unit", M.normalise_unit, "x / sqrt(sum(x * x) OVER c)", filled=True)
for _name in ("m9_normalise_minmax", "m10_normalise_mean", "m11_normalise_standardise", "m12_normalise_unit"):
    ORACLE_SQL[_name] += " WINDOW c AS (PARTITION BY col)"
on_matrix("m13_normalise_quantile", M.normalise_quantile, """SELECT row, col, round(a, 2) AS x FROM (SELECT *, dense_rank() OVER (PARTITION BY col ORDER BY x) AS d FROM f) JOIN
(SELECT r, avg(x) AS a FROM (SELECT x, row_number() OVER (PARTITION BY col ORDER BY x, row) AS r FROM f) GROUP BY r) ON d = r""", 2, True)
on_matrix("m14_normalise_softmax", lambda m: M.normalise_softmax(m.withColumn("x", F.col("x") / 100000)), "SELECT row, col, round(z / sum(z) OVER (PARTITION BY col), 8) AS x FROM (SELECT row, col, exp(x / 100000 - max(x / 100000) OVER (PARTITION BY col)) AS z FROM f)", 8, True)
query("m15_row_statistics", SPEND + """SELECT row, count(x) AS n, round(sum(x), 2) AS sum, min(x) AS low, max(x) AS high, round(max(x) - min(x), 2) AS range, round(avg(x), 6) AS mean, round(stddev_pop(x), 4) AS deviation,
round(CASE WHEN min(x) >= 0 AND avg(x) > 0 THEN stddev_pop(x) / avg(x) END, 6) AS variation, round(sqrt(sum(x * x)), 2) AS magnitude, arg_max(col, abs(x))::INT AS largest FROM m GROUP BY row""")(
    lambda spark, d: M.row_statistics(X.spend(spark, d)).select("row", "n", F.round("sum", 2).alias("sum"), "low", "high", F.round("range", 2).alias("range"), F.round("mean", 6).alias("mean"), F.round("deviation", 4).alias("deviation"), F.round("variation", 6).alias("variation"), F.round("magnitude", 2).alias("magnitude"), "largest")
)
query("m16_median_and_mad", SPEND + "SELECT row, round(min(md), 3) AS median, round(median(abs(x - md)), 3) AS mad FROM (SELECT *, median(x) OVER (PARTITION BY row) AS md FROM m) GROUP BY row")(
    lambda spark, d: M.median_and_mad(X.spend(spark, d)).select("row", F.round("median", 3).alias("median"), F.round("mad", 3).alias("mad"))
)
query("m17_tokenise_discrete", "SELECT c_mktsegment AS value, count(*) AS n, false AS zero FROM customer GROUP BY 1")(
    lambda spark, d: X.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("value"), M.tokenise_discrete(F.col("c_mktsegment")).alias("t")).count().select("value", F.col("count").alias("n"), (F.col("t") == 0).alias("zero"))
)

# tokens among which the zero token and missing ones occur
query("m17_tokenise_digits", "SELECT nullif(p_size % 10, 3)::VARCHAR AS value, count(*) AS n, coalesce(min(nullif(p_size % 10, 3)) = 0, true) AS zero FROM part GROUP BY 1")(
    lambda spark, d: X.table(spark, d, "part").select(F.nullif(F.col("p_size") % 10, F.lit(3)).cast("string").alias("value")).groupBy("value", M.tokenise_discrete(F.col("value")).alias("t")).count().select("value", F.col("count").alias("n"), (F.col("t") == 0).alias("zero"))
)

# similarity
PAIRS = "SELECT a.row AS a, b.row AS b, round({r}, 6) AS r FROM v a JOIN v b ON a.row < b.row WHERE {r} >= {t}"
VECTORS = "WITH v AS (SELECT vec_id AS row, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)\n"
COSINE = "list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v))"
rounded = lambda pairs: pairs.select("a", "b", F.round("r", 6).alias("r"))
FULL_ROWS = SPEND + ", v AS (SELECT row, list(x ORDER BY col) AS v FROM m GROUP BY row HAVING count(x) = 5)\n"
full_rows = lambda spark, d: X.spend(spark, d)
complete = lambda m: m.join(m.groupBy(F.col("row").alias("r_")).agg(F.count("x").alias("k_")).where("k_ = 5"), F.col("row") == F.col("r_")).select("row", "col", "x")
query("c1_pearson", FULL_ROWS + ", z AS (SELECT row, list_transform(v, lambda x: x - list_avg(v)) AS v FROM v) " + PAIRS.format(r=COSINE, t=0.95).replace("FROM v a JOIN v b", "FROM z a JOIN z b"))(
    lambda spark, d: C.all_pairs(C.pearson_rows(C.vectors(full_rows(spark, d))), 0.95, digits=6)
)
query("c2_spearman", SPEND + ", k AS (SELECT row, col, rank() OVER (PARTITION BY row ORDER BY x DESC)::DOUBLE AS x FROM m WHERE row IN (SELECT row FROM m GROUP BY row HAVING count(x) = 5)), z AS (SELECT row, list_transform(list(x ORDER BY col), lambda y: y - 3.0) AS v FROM k GROUP BY row) " + PAIRS.format(r=COSINE, t=0.85).replace("FROM v a JOIN v b", "FROM z a JOIN z b"))(
    lambda spark, d: C.all_pairs(C.spearman_rows(complete(full_rows(spark, d))), 0.85, digits=6)
)
query("c3_euclidean_similarity", VECTORS + PAIRS.format(r="1 / (1 + list_distance(a.v, b.v))", t=0.48))(lambda spark, d: C.all_pairs(X.similar(spark, d), 0.48, kind="euclidean", digits=6))
query("c4_cosine", VECTORS + PAIRS.format(r=COSINE, t=0.3))(lambda spark, d: C.all_pairs(C.cosine_rows(X.similar(spark, d)), 0.3, digits=6))
BICOR = SPEND + """, k AS (SELECT *, median(x) OVER (PARTITION BY row) AS md FROM m WHERE row IN (SELECT row FROM m GROUP BY row HAVING count(x) = 5)), d AS (SELECT *, median(abs(x - md)) OVER (PARTITION BY row) AS mad FROM k),
u AS (SELECT row, col, x - md AS y, (x - md) / (9 * mad) AS u FROM d WHERE mad > 0), z AS (SELECT row, list(CASE WHEN u * u < 1 THEN y * pow(1 - u * u, 2) ELSE 0 END ORDER BY col) AS v FROM u GROUP BY row) """
query("c5_bicor", BICOR + PAIRS.format(r=COSINE, t=0.95).replace("FROM v a JOIN v b", "FROM z a JOIN z b"))(lambda spark, d: C.all_pairs(C.bicor_rows(complete(full_rows(spark, d))), 0.95, digits=6))
TOKENS = "WITH v AS (SELECT p_partkey AS row, [p_brand, p_type, p_size::VARCHAR] AS v FROM part)\n"
parts = lambda spark, d: C.token_rows(X.table(spark, d, "part"), "p_partkey", ["p_brand", "p_type", "p_size"])
SAME = "((a.v[1] = b.v[1])::INT + (a.v[2] = b.v[2])::INT + (a.v[3] = b.v[3])::INT) / 3.0"
query("c6_jaccard", TOKENS + PAIRS.format(r=SAME, t=0.6))(lambda spark, d: C.all_pairs(parts(spark, d), 0.6, kind="jaccard", digits=6))
query("c7_smc", TOKENS + PAIRS.format(r=SAME, t=0.6))(lambda spark, d: C.all_pairs(parts(spark, d), 0.6, kind="smc", digits=6))
#: Customers by the number of orders of each priority; none is the zero token.
COUNTS = "WITH k AS (SELECT c_custkey AS row, p.col, count(o_orderkey) AS n FROM customer CROSS JOIN (VALUES ('1-URGENT', 0), ('2-HIGH', 1), ('3-MEDIUM', 2), ('4-NOT SPECIFIED', 3), ('5-LOW', 4)) p(name, col) LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = p.name GROUP BY 1, 2), v AS (SELECT row, list(n ORDER BY col) AS v FROM k GROUP BY row)\n"
MATCHES = " + ".join(f"(a.v[{k}] = b.v[{k}] AND a.v[{k}] {{some}})::INT" for k in range(1, 6))
EITHER = " + ".join(f"(a.v[{k}] > 0 OR b.v[{k}] > 0)::INT" for k in range(1, 6))


def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = X.table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderpriority", list(X.PRIORITIES)).count()
    return C.token_rows(X.table(spark, sf_dir, "customer").select("c_custkey").join(wide, F.col("c_custkey") == F.col("o_custkey"), "left"), "c_custkey", list(X.PRIORITIES))


query("c6_jaccard_of_counts", COUNTS + PAIRS.format(r=f"(({MATCHES.format(some='> 0')}) / greatest({EITHER}, 1))", t=0.75))(lambda spark, d: C.all_pairs(order_counts(spark, d), 0.75, kind="jaccard", digits=6))
query("c7_smc_of_counts", COUNTS + PAIRS.format(r=f"(({MATCHES.format(some='>= 0')}) / 5)", t=0.75))(lambda spark, d: C.all_pairs(order_counts(spark, d), 0.75, kind="smc", digits=6))
query("c8_binary_view", SPEND + "SELECT row, string_agg(CASE WHEN coalesce(x, 0) <> 0 THEN '1' ELSE '0' END, '' ORDER BY col) AS bits FROM m GROUP BY row")(
    lambda spark, d: C.binary_rows(C.vectors(M.impute_constant(X.spend(spark, d), 0.0))).select("row", F.array_join(F.transform("v", lambda x: x.cast("string")), "").alias("bits"))
)
query("c9_threshold_edges", VECTORS + PAIRS.format(r=COSINE, t=0.3).replace(f"WHERE {COSINE} >= 0.3", f"WHERE abs({COSINE}) >= 0.3"))(lambda spark, d: C.all_pairs(C.cosine_rows(X.similar(spark, d)), 0.3, "both", digits=6))
TOP = f", p AS (SELECT a.row AS a, b.row AS b, {COSINE} AS r FROM v a JOIN v b ON a.row < b.row WHERE {COSINE} >= 0.2), q AS (SELECT a, b, r, row_number() OVER (PARTITION BY me ORDER BY abs(r) DESC, other) AS k FROM (SELECT *, a AS me, b AS other FROM p UNION ALL SELECT *, b, a FROM p)) "
query("c10_knn_edges", VECTORS + TOP + "SELECT DISTINCT a, b, round(r, 6) AS r FROM q WHERE k <= 3")(lambda spark, d: rounded(C.top_k_edges(C.all_pairs(C.cosine_rows(X.similar(spark, d)), 0.2, limit=3), 3)))
query("c11_correlation_attributes", VECTORS + f'SELECT a.row AS src, b.row AS dst, round({COSINE}, 6) AS "Cosine Correlation", round(abs({COSINE}), 6) AS "Absolute Cosine Correlation" FROM v a JOIN v b ON a.row < b.row WHERE {COSINE} <= -0.3')(
    lambda spark, d: C.correlation_attributes(C.all_pairs(C.cosine_rows(X.similar(spark, d)), 0.3, "negative", digits=6), "Cosine")
)
query("c12_correlation_matrix", FULL_ROWS + ", z AS (SELECT row, list_transform(v, lambda x: x - list_avg(v)) AS v FROM v) SELECT a.row AS i, b.row AS j, round(CASE WHEN a.row = b.row THEN 1.0 ELSE " + COSINE + " END, 6) AS r FROM z a JOIN z b ON a.row <= b.row")(
    lambda spark, d: (lambda rows: C.correlation_matrix(C.all_pairs(rows, -2.0, digits=6), rows))(C.pearson_rows(C.vectors(X.spend(spark, d))))
)
query("c13_column_distance", SPEND + "SELECT a.col AS a, b.col AS b, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 2) AS distance FROM m a JOIN m b ON a.row = b.row AND a.col < b.col WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2")(
    lambda spark, d: C.column_distance(X.spend(spark, d)).select("a", "b", F.round("distance", 2).alias("distance"))
)
#: Heights and parents by what each column reaches through the pairs up to each step; the walk is the order of the paths.
LINKAGE = SPEND.replace("WITH m", "WITH RECURSIVE m") + """, d AS (SELECT a.col AS a, b.col AS b, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS distance FROM m a JOIN m b ON a.row = b.row AND a.col < b.col WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2),
e AS (SELECT *, row_number() OVER (ORDER BY distance, a, b) AS t FROM d), c AS (SELECT DISTINCT unnest([a, b]) AS v FROM d), b AS (SELECT a AS x, b AS y, t FROM e UNION ALL SELECT b, a, t FROM e),
reach(t, v, u) AS (SELECT t, v, v FROM e, c UNION SELECT r.t, r.v, b.y FROM reach r JOIN b ON b.x = r.u AND b.t <= r.t),
j AS (SELECT v, min(t) AS t FROM reach WHERE u < v GROUP BY v), p AS (SELECT j.v, j.t, min(u) AS parent FROM j JOIN reach USING (v, t) GROUP BY ALL),
walk AS (SELECT v, [v::BIGINT] AS path FROM c WHERE v NOT IN (SELECT v FROM p) UNION ALL SELECT p.v, list_append(path, p.t) FROM walk JOIN p ON p.parent = walk.v)
SELECT (row_number() OVER (ORDER BY path) - 1)::INT AS place, v AS col, round(coalesce(distance, 0.0), 2) AS height FROM walk LEFT JOIN p USING (v) LEFT JOIN e USING (t)"""
query("c14_column_cluster_order", LINKAGE)(lambda spark, d: C.column_cluster_order(C.column_distance(X.spend(spark, d))).select("place", "col", F.round("height", 2).alias("height")))
query("c15_rows_of_interest", FULL + ", s AS (SELECT row, sum(x) FILTER (col IN (0, 1)) - avg(x) FILTER (col NOT IN (0, 1)) AS score FROM f GROUP BY row) SELECT row, round(score, 2) AS score, row_number() OVER (ORDER BY score DESC, row) AS rank FROM s WHERE score >= (SELECT quantile_cont(score, 0.9) FROM s)")(
    lambda spark, d: C.rows_of_interest(M.impute_constant(X.spend(spark, d), 0.0), [0, 1]).select("row", F.round("score", 2).alias("score"), "rank")
)
query("c16_grouped_value_counts", """WITH c AS (SELECT p_type AS "group", p_brand AS value, count(*) AS n FROM part GROUP BY 1, 2 UNION ALL SELECT 'sizes of ' || p_type, (p_size % 10)::VARCHAR, count(*) FROM part GROUP BY 1, 2)
SELECT "group", CASE WHEN k < 16 THEN value END AS value, CAST(sum(n) AS BIGINT) AS count FROM (SELECT *, count(*) OVER (PARTITION BY "group") AS k FROM c) GROUP BY 1, 2""")(
    lambda spark, d: C.grouped_value_counts(X.table(spark, d, "part").select(F.explode(F.array(F.struct(F.col("p_type").alias("g"), F.col("p_brand").alias("v")), F.struct(F.concat(F.lit("sizes of "), F.col("p_type")).alias("g"), (F.col("p_size") % 10).cast("string").alias("v")))).alias("s")).select("s.*"), "g", "v")
)
query("c17_import_column_annotations", "SELECT n_name AS name, n_nationkey AS place, n_regionkey AS region FROM nation")(
    lambda spark, d: C.import_column_annotations(X.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("place")), X.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
)
# an annotation that is replaced, one of another type under a taken name, and columns without a match
query("c17_replace_column_annotations", "SELECT n_name AS name, CASE WHEN n_regionkey < 3 THEN n_nationkey + 100 END AS place, 'r' || n_regionkey AS region, CASE WHEN n_regionkey < 3 THEN n_regionkey END AS \"region(1)\" FROM nation")(
    lambda spark, d: C.import_column_annotations(
        X.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("place"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("region")),
        X.table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 100).cast("long").alias("place"), F.col("n_regionkey").cast("long").alias("region")),
    )
)
query("c18_annotation_profile", "WITH f AS (SELECT p_size::VARCHAR AS value, min(p_partkey) AS first FROM part GROUP BY 1) SELECT value, row_number() OVER (ORDER BY first) - 1 AS index, true AS numeric, round((value::DOUBLE - (SELECT min(p_size) FROM part)) / (SELECT max(p_size) - min(p_size) FROM part), 6) AS unit FROM f")(
    lambda spark, d: C.annotation_profile(X.table(spark, d, "part"), "p_partkey", "p_size").select("value", "index", "numeric", F.round("unit", 6).alias("unit"))
)

# structure
on_graph(X.geo, "g1_connected_components", lambda g: G.connected_components(g).nodes.select("id", "component"), GEO + "SELECT id, component FROM comp")
on_graph(X.geo, "g2_component_sizes", G.component_sizes, GEO + "SELECT component, count(*) AS num_nodes, count(*) - 1 AS num_edges FROM comp GROUP BY 1")
on_graph(X.geo, "g2_largest_component", G.largest_component, GEO + "SELECT component, count(*) AS num_nodes, count(*) - 1 AS num_edges FROM comp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
on_graph(X.supply, "g3_degrees", G.degrees, SUPPLY + "SELECT n.id, count(edge_id) AS degree, count(edge_id) FILTER (side = 'in') AS in_degree, count(edge_id) FILTER (side = 'out') AS out_degree FROM n LEFT JOIN inc ON node = n.id GROUP BY 1")
some = lambda g: g.nodes.where("name IN ('P3', 'P70', 'S7', 'S8')").select("id")
SOME = "(SELECT id FROM n WHERE name IN ('P3', 'P70', 'S7', 'S8'))"
on_graph(X.supply, "g4_neighbours_of", lambda g: G.neighbours_of(g, some(g)), SUPPLY + f"SELECT node, other AS neighbour, edge_id FROM inc WHERE node IN {SOME}")
on_graph(X.supply, "g4_sources_of", lambda g: G.sources_of(g, some(g)), SUPPLY + f"SELECT dst AS node, src AS neighbour, edge_id FROM e WHERE dst IN {SOME}")
on_graph(X.supply, "g4_targets_of", lambda g: G.targets_of(g, some(g)), SUPPLY + f"SELECT src AS node, dst AS neighbour, edge_id FROM e WHERE src IN {SOME}")
asked = lambda g: g.edges.where("quantity >= 100").select(F.col("dst").alias("a"), F.col("src").alias("b"))
on_graph(X.supply, "g5_edges_between", lambda g: G.edges_between(g, asked(g)), SUPPLY + "SELECT dst AS a, src AS b, edge_id FROM e WHERE quantity >= 100")
on_graph(X.supply, "g5_first_edge_between", lambda g: G.first_edge_between(g, asked(g).union(asked(g).select("a", "a"))), SUPPLY + 'SELECT dst AS a, src AS b, edge_id, true AS "exists" FROM e WHERE quantity >= 100 UNION ALL SELECT DISTINCT dst, dst, NULL, false FROM e WHERE quantity >= 100')
on_graph(X.supply, "g6_edges_for_nodes", lambda g: G.edges_for_nodes(g, some(g)).select("edge_id", "src", "dst", "quantity", "lines"), SUPPLY + f"SELECT {EDGES} FROM e WHERE src IN {SOME} OR dst IN {SOME}")
on_graph(X.supply, "g7_remove_nodes", lambda g: both(G.remove_nodes(g, some(g))), SUPPLY + f", kn AS (SELECT * FROM n WHERE id NOT IN {SOME}), ke AS (SELECT * FROM e WHERE src NOT IN {SOME} AND dst NOT IN {SOME}) " + BOTH)
on_graph(X.supply, "g7_remove_edges", lambda g: edges(G.remove_edges(g, g.edges.where("lines > 1").select("edge_id"))), SUPPLY + f"SELECT {EDGES} FROM e WHERE lines <= 1")
on_graph(X.supply, "g8_crop_to", lambda g: both(G.crop_to(g, g.nodes.where("worth < 1000").select("id"))), SUPPLY + ", kn AS (SELECT * FROM n WHERE worth < 1000), ke AS (SELECT * FROM e WHERE src IN (SELECT id FROM kn) AND dst IN (SELECT id FROM kn)) " + BOTH)
on_graph(X.supply, "g9_add_elements", lambda g: both(G.add_edges(G.add_nodes(g, some(g).select((F.col("id") + 100000000).alias("id"), F.lit("new").alias("name"))), some(g).select((F.col("id") + 100000000).alias("edge_id"), F.col("id").alias("src"), F.col("id").alias("dst")))),
         SUPPLY + ", kn AS (SELECT id FROM n UNION ALL SELECT id + 100000000 FROM n WHERE id IN " + SOME + "), ke AS (SELECT edge_id FROM e UNION ALL SELECT id + 100000000 FROM n WHERE id IN " + SOME + ") " + BOTH)
on_graph(X.supply, "g10_graph_diff", lambda g: G.graph_diff(g, G.remove_nodes(g, some(g))), SUPPLY + f"SELECT 'node' AS element, id, 'removed' AS change FROM n WHERE id IN {SOME} UNION ALL SELECT 'edge', edge_id, 'removed' FROM e WHERE src IN {SOME} OR dst IN {SOME}")
on_graph(X.supply, "g11_check_consistency", lambda g: G.check_consistency(g.with_nodes(g.nodes.where("worth < 9000"))), SUPPLY + "SELECT 'src missing' AS problem, edge_id AS id FROM e WHERE src IN (SELECT id FROM n WHERE worth >= 9000) UNION ALL SELECT 'dst missing', edge_id FROM e WHERE dst IN (SELECT id FROM n WHERE worth >= 9000)")
merged = lambda g: T.contract_edges_where(g, P.source("kind") == "supplier", ("kind",))
#: Suppliers contract into their nations: heads are the least ids of nation and suppliers.
MERGED = GEO + ", h AS (SELECT n.id, coalesce(g.head, n.id) AS head FROM n LEFT JOIN (SELECT x.id, least(min(x.id) OVER (PARTITION BY x.g), x.g) AS head FROM (SELECT src AS id, dst AS g FROM e JOIN n ON n.id = src AND kind = 'supplier' UNION SELECT dst, dst FROM e JOIN n ON n.id = src AND kind = 'supplier') x) g ON g.id = n.id) "
on_graph(X.geo, "g12_merge_sets", lambda g: G.merge_sets(merged(g)), MERGED + "SELECT head, id AS node, CASE WHEN count(*) OVER (PARTITION BY head) = 1 THEN 'not' WHEN id = head THEN 'head' ELSE 'tail' END AS kind, count(*) OVER (PARTITION BY head) AS multiplicity FROM h")

# transforms
on_graph(X.supply, "t1_remove_nodes_where", lambda g: both(T.remove_nodes_where(g, F.col("brand") == "Brand#2")), SUPPLY + ", kn AS (SELECT * FROM n WHERE NOT coalesce(brand = 'Brand#2', false)), ke AS (SELECT * FROM e WHERE src IN (SELECT id FROM kn) AND dst IN (SELECT id FROM kn)) " + BOTH)
on_graph(X.supply, "t1_keep_nodes_where", lambda g: both(T.keep_nodes_where(g, P.any_of(F.col("brand") == "Brand#2", F.col("kind") == "supplier"))), SUPPLY + ", kn AS (SELECT * FROM n WHERE coalesce(brand = 'Brand#2', false) OR kind = 'supplier'), ke AS (SELECT * FROM e WHERE src IN (SELECT id FROM kn) AND dst IN (SELECT id FROM kn)) " + BOTH)
on_graph(X.supply, "t2_remove_edges_where", lambda g: edges(T.remove_edges_where(g, P.less(F.col("quantity"), 40))), SUPPLY + f"SELECT {EDGES} FROM e WHERE NOT quantity < 40")
on_graph(X.supply, "t2_keep_edges_where", lambda g: edges(T.keep_edges_where(g, P.less(P.source("worth"), P.target("worth")), ("worth",))), SUPPLY + "SELECT edge_id, src, dst, quantity, lines FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.worth < b.worth")
on_graph(X.geo, "t3_keep_components_where", lambda g: both(T.keep_components_where(g, F.col("num_nodes") % 2 == 0)), GEO + ", kn AS (SELECT id FROM comp WHERE component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) % 2 = 0)), ke AS (SELECT * FROM e WHERE src IN (SELECT id FROM kn)) " + BOTH)
on_graph(X.geo, "t3_remove_components_where", lambda g: both(T.remove_components_where(g, F.col("num_edges") % 2 == 0)), GEO + ", kn AS (SELECT id FROM comp WHERE component NOT IN (SELECT component FROM comp GROUP BY 1 HAVING (count(*) - 1) % 2 = 0)), ke AS (SELECT * FROM e WHERE src IN (SELECT id FROM kn)) " + BOTH)
on_graph(X.geo, "t4_contract_edges_where", lambda g: merged(g).edges.select("edge_id", "src", "dst", "multiplicity"), MERGED + ", r AS (SELECT edge_id, a.head AS src, b.head AS dst FROM e JOIN h a ON a.id = src JOIN h b ON b.id = dst WHERE a.head <> b.head) SELECT min(edge_id) AS edge_id, arg_min(src, edge_id) AS src, arg_min(dst, edge_id) AS dst, count(*) AS multiplicity FROM r GROUP BY least(src, dst), greatest(src, dst)")
named = lambda g: g.with_nodes(g.nodes.withColumn("group", F.when(F.col("kind").isin("nation", "region"), "land").otherwise(F.col("kind"))))
on_graph(X.geo, "t5_contract_by_attribute", lambda g: T.contract_by_attribute(named(g), "group").nodes.select("id", "head", "multiplicity"), GEO + ", l AS (SELECT comp.id, min(comp.id) OVER (PARTITION BY component) AS head FROM comp JOIN n USING (id) WHERE kind IN ('nation', 'region')) SELECT id, head, count(*) OVER (PARTITION BY head) AS multiplicity FROM (SELECT n.id, coalesce(head, n.id) AS head FROM n LEFT JOIN l USING (id))")
on_graph(X.geo, "t6_separate_by_attribute", lambda g: T.separate_by_attribute(named(g), "group").edges.select("edge_id"), GEO + "SELECT edge_id FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.kind = 'nation' AND b.kind = 'region'")
LEAFLESS = GEO + ", kn AS (SELECT id FROM n WHERE (SELECT count(*) FROM e WHERE src = n.id) + (SELECT count(*) FROM e WHERE dst = n.id) > 1), ke AS (SELECT * FROM e WHERE src IN (SELECT id FROM kn) AND dst IN (SELECT id FROM kn)) " + BOTH
on_graph(X.geo, "t7_remove_leaves", lambda g: both(T.remove_leaves(g)), LEAFLESS)
# a step that names an unknown attribute is left out
on_graph(X.geo, "r1_pipeline", lambda g: both(Pipeline(g).run([step(T.separate_by_attribute, attribute="no such attribute"), step(T.remove_leaves, limit=1)])), LEAFLESS)
on_graph(X.geo, "t8_remove_branches", lambda g: both(T.remove_branches(g)), GEO + "SELECT 'node' AS element, id FROM n WHERE false")
on_graph(X.geo, "t9_spanning_tree", lambda g: T.spanning_tree(g).edges.select("edge_id"), GEO + "SELECT edge_id FROM e")
# the pairs of 60 or more: some hang from the core, some are in it; src are parts and dst suppliers
CORE = SUPPLY.replace("WITH n", "WITH RECURSIVE n", 1) + """, r AS (SELECT 0 AS k, edge_id, src, dst FROM e WHERE quantity >= 60
  UNION ALL SELECT k + 1, edge_id, src, dst FROM (SELECT *, min(least(a, b)) OVER () AS fewest FROM (SELECT *, count(*) OVER (PARTITION BY src) AS a, count(*) OVER (PARTITION BY dst) AS b FROM r)) WHERE fewest = 1 AND a > 1 AND b > 1),
ke AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY src) AS a, count(*) OVER (PARTITION BY dst) AS b FROM r WHERE k = (SELECT max(k) FROM r)) WHERE a > 1 AND b > 1), kn AS (SELECT src AS id FROM ke UNION SELECT dst FROM ke) """
many = lambda g: T.keep_edges_where(g, P.at_least(F.col("quantity"), 60))
on_graph(X.supply, "t8_core_of_supply", lambda g: both(T.remove_branches(many(g))), CORE + BOTH)
on_graph(X.supply, "r2_repeated_step", lambda g: both(Pipeline(many(g).cut()).run([step(T.remove_leaves, repeating=True)])), CORE + BOTH)
#: The users graph in SQL: nodes n, edges e, both ways around, components comp.
USERS = """WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY name) - 1 AS id, name FROM (SELECT DISTINCT 'U' || user_id AS name FROM events WHERE user_id IS NOT NULL)),
l AS (SELECT lag('U' || user_id) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS f, 'U' || user_id AS t FROM events),
e AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, * FROM (SELECT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst, count(*) AS cells FROM l JOIN n a ON a.name = f JOIN n b ON b.name = t WHERE f <> t GROUP BY 1, 2)),
around AS (SELECT edge_id, src AS node, dst AS other FROM e UNION ALL SELECT edge_id, dst, src FROM e),
reach AS (SELECT id AS a, id AS b FROM n UNION SELECT a, node FROM reach JOIN around ON other = b), comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY 1)
"""
on_graph(X.users, "t9_tree_of_users", lambda g: T.spanning_tree(g).edges.select("edge_id"), USERS + """, lev AS (SELECT DISTINCT component AS id, 0 AS l FROM comp UNION SELECT node, l + 1 FROM lev JOIN around ON other = lev.id WHERE l < (SELECT count(*) FROM n)),
d AS (SELECT id, min(l) AS l FROM lev GROUP BY 1) SELECT min(edge_id) AS edge_id FROM around JOIN d a ON a.id = node JOIN d b ON b.id = other WHERE b.l = a.l - 1 GROUP BY node""")
on_graph(X.users, "a1_pagerank_of_users", lambda g: K.pagerank(g).select("id", F.round("pagerank", 6).alias("pagerank")), USERS + """, z AS (SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM comp),
w AS (SELECT node, other, 1.0::DOUBLE / count(*) OVER (PARTITION BY other) AS share, 0.0::DOUBLE AS own FROM around UNION ALL SELECT id, id, 0.0, 1.0 FROM n),
pr AS (SELECT 0 AS k, id, component, size, 1.0::DOUBLE / size AS rank, 9.0::DOUBLE AS change FROM z
  UNION ALL SELECT k + 1, node, component, size, rank, sum(abs(rank - was)) OVER (PARTITION BY component) FROM (
    SELECT k, node, component, size, 0.2::DOUBLE / size + 0.8::DOUBLE * sum(share * rank) AS rank, sum(own * rank) AS was FROM pr JOIN w ON other = id WHERE NOT (size = 1 AND k > 0) AND NOT (k > 0 AND k % 5 = 0 AND change <= 1e-6) GROUP BY k, node, component, size))
SELECT id, round(rank / max(rank) OVER (PARTITION BY component), 6) AS pagerank FROM (SELECT * FROM pr QUALIFY k = max(k) OVER (PARTITION BY component))""")


def reused_prefix(g: Graph) -> DataFrame:
    """Two lists of steps with a first step in common: what the second gives, and whether that step's result was taken over."""
    pipeline, first = Pipeline(many(g).cut()), step(T.remove_leaves, limit=1)
    pipeline.run([first, step(T.remove_branches)])
    held = pipeline.kept[(first,)]
    out = pipeline.run([first, step(T.remove_leaves, repeating=True)])
    return both(out).withColumn("reused", F.lit(pipeline.kept[(first,)] is held and len(pipeline.kept) == 2))


on_graph(X.supply, "r3_reused_prefix", reused_prefix, CORE + "SELECT *, true AS reused FROM (" + BOTH + ")")
on_graph(X.supply, "t10_edge_reduction", lambda g: T.edge_reduction(g).edges.select("edge_id"))
NEAR = ", k AS (SELECT edge_id, side, r FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY quantity DESC, edge_id) AS r, count(*) OVER (PARTITION BY node) AS deg FROM inc) WHERE r <= {k}), s AS (SELECT edge_id, coalesce(max(r) FILTER (side = 'out'), 0) AS a, coalesce(max(r) FILTER (side = 'in'), 0) AS b FROM k GROUP BY 1) SELECT edge_id, a AS \"{p} Source Rank\", b AS \"{p} Target Rank\", CASE WHEN a > 0 AND b > 0 THEN (a + b) / 2 ELSE greatest(a, b) END::DOUBLE AS \"{p} Mean Rank\" FROM s"
ranks = lambda g, p: g.edges.select("edge_id", *[f"{p} {n} Rank" for n in ("Source", "Target", "Mean")])
on_graph(X.supply, "t11_knn_edges", lambda g: ranks(T.knn_edges(g, "quantity", 5), "k-NN"), SUPPLY + NEAR.format(k=5, p="k-NN"))
on_graph(X.supply, "t12_percent_nn", lambda g: ranks(T.percent_nn(g, "quantity", 10, 5), "%-NN"), SUPPLY + NEAR.format(k="greatest(floor(deg * 10 / 100), 5)", p="%-NN"))

# metrics and clusters
on_graph(X.geo, "a1_pagerank", lambda g: K.pagerank(g).select("id", F.round("pagerank", 4).alias("pagerank")))
on_graph(X.geo, "a2_betweenness", lambda g: (lambda h: K.betweenness(h)[0].join(h.nodes.select("id", "name"), "id").select("name", F.round("betweenness", 4).alias("betweenness")))(g),
         GEO + """, t AS (SELECT comp.id, component, kind, name FROM comp JOIN n USING (id)), sz AS (SELECT component, count(*) AS size FROM t GROUP BY 1),
below AS (SELECT e.dst AS id, 1 + (SELECT count(*) FROM e f JOIN t u ON u.id = f.src WHERE f.dst = e.src) AS part FROM e JOIN t ON t.id = e.src)
SELECT name, round(coalesce((SELECT (size - 1) * (size - 1) - sum(part * part) - CASE WHEN t.kind = 'nation' THEN (size - 1 - sum(part)) * (size - 1 - sum(part)) ELSE 0 END FROM below WHERE below.id = t.id), 0), 4)::DOUBLE AS betweenness FROM t JOIN sz USING (component)""")  # fmt: skip
on_graph(X.geo, "a3_eccentricity", lambda g: (lambda h: K.eccentricity(h).join(h.nodes.select("id", "name"), "id").select("name", "eccentricity"))(g),
         GEO + """, t AS (SELECT comp.id, component, kind, name FROM comp JOIN n USING (id)), te AS (SELECT src, dst FROM e JOIN t ON t.id = src UNION ALL SELECT dst, src FROM e JOIN t ON t.id = src),
walk AS (SELECT id AS s, id AS v, -1 AS was, 0 AS hops FROM t UNION ALL SELECT s, te.dst, v, hops + 1 FROM walk JOIN te ON te.src = v WHERE te.dst <> was) SELECT name, CAST(max(hops) AS BIGINT) AS eccentricity FROM walk JOIN t ON t.id = s GROUP BY s, name""")  # fmt: skip
on_graph(X.geo, "a4_louvain", lambda g: L.louvain(g))
on_graph(X.geo, "a5_weighted_louvain", lambda g: L.louvain(g.with_edges(g.edges.withColumn("pull", F.col("edge_id") % 7 + 1)), weight="pull"))
on_graph(X.geo, "a6_mcl", lambda g: L.mcl(g))
on_graph(X.geo, "a7_cluster_sizes", lambda g: L.cluster_sizes(G.connected_components(g).nodes.select("id", F.col("component").alias("community"))), GEO + ", z AS (SELECT component, count(*) AS size FROM comp GROUP BY 1) SELECT id, 'Cluster ' || r AS cluster, size FROM comp JOIN (SELECT *, row_number() OVER (ORDER BY size DESC, component DESC) AS r FROM z) USING (component)")

# attributes and predicates
customers = lambda spark, d: X.table(spark, d, "customer")
query("b1_synthesise_attribute", "SELECT c_custkey, CASE WHEN regexp_matches(c_name, '#0*([0-9]*[02468])$') THEN try_cast(regexp_extract(c_name, '#0*([0-9]*[02468])$', 1) AS BIGINT) END AS number FROM customer")(
    lambda spark, d: A.synthesise_attribute(customers(spark, d), "c_name", "number", "^.*#0*([0-9]*[02468])$").select("c_custkey", "number")
)
query("b2_combine_attributes", "SELECT c_custkey, c_mktsegment || '/' || c_nationkey AS both FROM customer")(lambda spark, d: A.combine_attributes(customers(spark, d), "c_mktsegment", "c_nationkey", "both", r"\1/\2").select("c_custkey", "both"))
query("b3_boolean_attribute", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'True' ELSE 'False' END AS rich FROM customer")(lambda spark, d: A.boolean_attribute(customers(spark, d), "rich", P.greater(F.col("c_acctbal"), 5000)).select("c_custkey", "rich"))
query("b4_average_by_category", 'SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 4) AS mean FROM customer')(
    lambda spark, d: A.average_by_category(customers(spark, d), "c_acctbal", "c_mktsegment").select("c_custkey", F.round("Mean c_acctbal of c_mktsegment", 4).alias("mean"))
)
query("b5_cast_attribute", "SELECT c_custkey, c_custkey::VARCHAR AS text, coalesce(try_cast(c_mktsegment AS BIGINT), 0) AS number, c_nationkey::DOUBLE AS nation FROM customer")(
    lambda spark, d: A.cast_attribute(A.cast_attribute(A.cast_attribute(customers(spark, d), "c_custkey", "text", "String"), "c_mktsegment", "number", "Integer"), "c_nationkey", "nation", "Float").select("c_custkey", "text", "number", "nation")
)
on_graph(X.geo, "b6_forward_merged_attribute", lambda g: A.forward_merged_attribute(merged(g).nodes, "label").select("id", "label"), MERGED + "SELECT h.id, n.label FROM h JOIN n ON n.id = h.head")
query("b7_attribute_range", "SELECT c_mktsegment, 'c_acctbal' AS attribute, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, 'c_nationkey', min(c_nationkey), max(c_nationkey) FROM customer GROUP BY 1")(
    lambda spark, d: A.attribute_range(customers(spark, d), "c_acctbal", "c_nationkey", by="c_mktsegment")
)
query("b8_shared_values", "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1")(lambda spark, d: A.shared_values(X.table(spark, d, "part"), "p_brand"))
query("b9_infer_attribute_type", "SELECT p_partkey, p_size::BIGINT AS size FROM part")(lambda spark, d: A.retyped(X.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("size")), "size"))
query("b10_attribute_statistics", "SELECT c_mktsegment, count(c_acctbal) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high, round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS deviation FROM customer GROUP BY 1")(
    lambda spark, d: A.attribute_statistics(customers(spark, d), "c_acctbal", "c_mktsegment").select("c_mktsegment", "n", "low", "high", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"))
)
query("b11_map_to_unit", "WITH s AS (SELECT c_custkey, c_acctbal AS x, greatest(avg(c_acctbal) OVER w - stddev_pop(c_acctbal) OVER w, min(c_acctbal) OVER w) AS lo, least(avg(c_acctbal) OVER w + stddev_pop(c_acctbal) OVER w, max(c_acctbal) OVER w) AS hi FROM customer WINDOW w AS (PARTITION BY c_mktsegment)) SELECT c_custkey, round(1 - pow((least(greatest(x, lo), hi) - lo) / (hi - lo), 2), 6) AS unit FROM s")(
    lambda spark, d: A.map_to_unit(customers(spark, d), "c_acctbal", "unit", "stddev", exponent=2.0, invert=True, by="c_mktsegment").select("c_custkey", F.round("unit", 6).alias("unit"))
)
on_graph(X.geo, "b12_label_groups", lambda g: A.label_groups(named(g), "group"), GEO + "SELECT min(comp.id) AS component, 'land' AS label, count(*) AS nodes FROM comp JOIN n USING (id) WHERE kind IN ('nation', 'region') GROUP BY comp.component UNION ALL SELECT id, kind, 1 FROM n WHERE kind NOT IN ('nation', 'region')")
query("b13_import_attributes", "SELECT c_custkey, (SELECT arg_min(o_totalprice, o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS price FROM customer")(
    lambda spark, d: A.import_attributes(customers(spark, d), X.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price")), "c_custkey", "o_custkey", ["price"], order="o_orderkey").select("c_custkey", "price")
)
query("b14_clone_attribute", 'SELECT c_custkey, c_nationkey::BIGINT AS "c_nationkey(1)" FROM customer')(lambda spark, d: A.clone_attribute(customers(spark, d), "c_nationkey").select("c_custkey", "c_nationkey(1)"))
query("b15_remove_attributes", "SELECT c_custkey, c_name FROM customer")(lambda spark, d: A.remove_attributes(customers(spark, d), "c_nationkey", "c_acctbal", "c_mktsegment", "id"))
query("b16_edit_attribute", "SELECT c_custkey, CASE WHEN c_custkey < 10 THEN -1.0 ELSE c_nationkey END::DOUBLE AS c_nationkey FROM customer")(
    lambda spark, d: A.edit_attribute(customers(spark, d), "c_nationkey", customers(spark, d).where("c_custkey < 10").select("c_custkey", F.lit(-1)), "c_custkey", "double").select("c_custkey", "c_nationkey")
)
on_part = lambda name, condition, sql: query(name, f"SELECT p_partkey FROM part WHERE {sql}")(lambda spark, d: X.table(spark, d, "part").where(condition()).select("p_partkey"))
on_part("f1_equality", lambda: P.all_of(P.differs(F.col("p_brand"), "Brand#2"), P.equals(F.col("p_type"), "ECONOMY")), "p_brand <> 'Brand#2' AND p_type = 'ECONOMY'")
on_part("f2_order", lambda: P.all_of(P.greater(F.col("p_size"), 10), P.at_most(F.col("p_retailprice"), 1200)), "p_size > 10 AND p_retailprice <= 1200")
on_part("f3_text", lambda: P.any_of(P.includes(F.col("p_name"), "al"), P.all_of(P.starts(F.col("p_name"), "b"), P.ends(F.col("p_name"), "t")), P.all_of(P.excludes(F.col("p_name"), "e"), P.equals(F.col("p_size"), 1))), "contains(p_name, 'al') OR (starts_with(p_name, 'b') AND ends_with(p_name, 't')) OR (NOT contains(p_name, 'e') AND p_size = 1)")
on_part("f4_patterns", lambda: P.any_of(P.matches(F.col("p_name"), "^s.*g$"), P.matches(F.col("p_brand"), "bRAND#1.$", False)), "regexp_matches(p_name, '^s.*g$') OR regexp_matches(p_brand, '(?i)bRAND#1.$')")
on_graph(X.supply, "f5_has_value", lambda g: g.nodes.where(P.has_value(F.col("brand"))).select("id"), SUPPLY + "SELECT id FROM n WHERE brand IS NOT NULL")
on_part("f7_attribute_to_attribute", lambda: P.less(F.col("p_size") * 50, F.col("p_retailprice")), "p_size * 50 < p_retailprice")
on_graph(X.supply, "f8_end_attributes", lambda g: P.with_end_attributes(g, "kind", "worth").where(P.all_of(P.equals(P.source("kind"), "part"), P.less(P.target("worth"), 0))).select("edge_id"), SUPPLY + "SELECT edge_id FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.kind = 'part' AND b.worth < 0")

# search, selections, enrichment, order
on_graph(X.geo, "q1_find_nodes", lambda g: S.find_nodes(g, "nation_1", ("label",)), GEO + "SELECT id FROM n WHERE regexp_matches(label, '(?i)nation_1')")
on_graph(X.geo, "q1_find_whole_word", lambda g: S.find_nodes(g, "east", ("name", "label"), whole_word=True), GEO + "SELECT id FROM n WHERE regexp_matches(coalesce(label, ''), '(?i)\\b(?:east)\\b') OR regexp_matches(name, '(?i)\\b(?:east)\\b')")
rich = lambda g: g.nodes.where("balance > 9000").select("id")
mask = lambda g: g.nodes.where("kind = 'customer'").select("id")
on_graph(X.geo, "q2_select", lambda g: S.select(g, rich(g), g.nodes.where("balance < -900").select("id"), mask(g)), GEO + "SELECT id FROM n WHERE balance > 9000 OR (balance < -900 AND kind = 'customer')")
on_graph(X.geo, "q2_deselect", lambda g: S.deselect(g, rich(g), mask(g)), GEO + "SELECT id FROM n WHERE balance > 9000 AND kind <> 'customer'")
on_graph(X.geo, "q2_invert", lambda g: S.invert(g, rich(g), mask(g)), GEO + "SELECT id FROM n WHERE kind = 'customer' AND NOT coalesce(balance > 9000, false)")
on_graph(X.geo, "q2_select_all", lambda g: S.select_all(g), GEO + "SELECT id FROM n")
on_graph(X.geo, "q3_bookmarks", lambda g: S.bookmark(S.bookmark(None, "rich", rich(g)), "all customers", mask(g)), GEO + "SELECT 'rich' AS name, id AS node FROM n WHERE balance > 9000 UNION ALL SELECT 'all customers', id FROM n WHERE kind = 'customer'")
ENRICH = """WITH t AS (SELECT p_brand AS a, p_type AS b FROM part), n AS (SELECT count(*) AS n FROM t), r AS (SELECT a, count(*) AS r FROM t GROUP BY 1), c AS (SELECT b, count(*) AS c FROM t GROUP BY 1),
o AS (SELECT r.a, c.b, r, c, n, (SELECT count(*) FROM t WHERE t.a = r.a AND t.b = c.b) AS o FROM r CROSS JOIN c CROSS JOIN n),
h AS (SELECT *, unnest(range(greatest(0, r + c - n), least(r, c) + 1)) AS k FROM o),
l AS (SELECT *, lgamma(r + 1) + lgamma(n - r + 1) + lgamma(c + 1) + lgamma(n - c + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(r - k + 1) - lgamma(c - k + 1) - lgamma(n - r - c + k + 1) AS p FROM h),
f AS (SELECT l.a, l.b, least(1.0, sum(exp(l.p)) FILTER (l.p <= q.p + 1e-9)) AS p FROM l JOIN l q ON q.a = l.a AND q.b = l.b AND q.k = q.o GROUP BY 1, 2)
"""
enriched = lambda spark, d: E.enrichment(X.table(spark, d, "part"), "p_brand", "p_type")
query("e1_enrichment", ENRICH + "SELECT a AS value_a, b AS value_b, o AS observed, round(r / n * c, 6) AS expected, round(o / (r / n * c), 6) AS representation, round(p, 6) AS p, round(least(p * (SELECT count(*) FROM c), 1), 6) AS bonferroni FROM o JOIN f USING (a, b)")(
    lambda spark, d: enriched(spark, d).select("value_a", "value_b", "observed", *[F.round(c, 6).alias(c) for c in ("expected", "representation", "p", "bonferroni")])
)
query("e3_expected_deviation", ENRICH + "SELECT a AS value_a, b AS value_b, round(sqrt(r / n * (1 - r / n) * c), 6) AS deviation FROM o")(lambda spark, d: enriched(spark, d).select("value_a", "value_b", F.round("deviation", 6).alias("deviation")))
query("e4_enriched_only", ENRICH + "SELECT a AS value_a, b AS value_b, o AS observed FROM o JOIN f USING (a, b) WHERE o / (r / n * c) > 1 AND least(p * (SELECT count(*) FROM c), 1) <= 0.5")(lambda spark, d: E.enriched_only(enriched(spark, d), 0.5).select("value_a", "value_b", "observed"))
query("o1_natural_sort", "SELECT p_brand, row_number() OVER (ORDER BY regexp_extract(p_brand, '[0-9]+')::INT) AS place FROM (SELECT DISTINCT p_brand FROM part)")(
    lambda spark, d: X.table(spark, d, "part").select("p_brand").distinct().withColumn("place", F.row_number().over(Window.orderBy(S.natural_key(F.col("p_brand"))))).select("p_brand", "place")  # few brands
)
query("o2_sort_filter_table", "SELECT p_partkey, p_size FROM part WHERE p_size >= 40")(lambda spark, d: S.sort_filter_table(X.table(spark, d, "part").select("p_partkey", "p_size"), F.col("p_size") >= 40, "p_size", False))
on_graph(X.supply, "k1_pairwise_lines", lambda g: writers.pairwise_lines(g, "lines"), SUPPLY + "SELECT '\"' || a.name || '\" \"' || b.name || '\" ' || lines AS value FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst")
on_graph(X.geo, "k2_json_elements", lambda g: writers.json_elements(g).select(F.get_json_object("value", "$.kind").alias("kind"), F.get_json_object("value", "$.id").cast("long").alias("id"), F.get_json_object("value", "$.metadata.label").alias("label")), GEO + "SELECT 'node' AS kind, id, label FROM n UNION ALL SELECT 'edge', edge_id, NULL FROM e")
on_graph(X.geo, "k4_attribute_table", lambda g: writers.attribute_table(g.nodes, ["name", "balance", "kind"], "name"), GEO + "SELECT name, balance, kind FROM n")


# files of the customers and their nations, in the formats that hold graphs
def customer_documents(spark: SparkSession, sf_dir: str) -> str:
    """JSON graphs, one file for each thousand customer keys with the nations that they name; the folder."""
    customers = X.table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 1000).alias("block"), X.key("C", "c_custkey").alias("c"), X.key("N", "c_nationkey").alias("n"), "c_mktsegment")
    node = lambda name, segment: F.struct(F.col(name).alias("id"), F.col(name).alias("label"), F.struct(segment.alias("segment")).alias("metadata"))
    nodes = F.concat(F.collect_list(node("c", F.col("c_mktsegment"))), F.collect_set(node("n", F.lit("")))).alias("nodes")
    edges = F.collect_list(F.struct(F.col("c").alias("source"), F.col("n").alias("target"))).alias("edges")
    documents = customers.groupBy("block").agg(F.to_json(F.struct(F.struct(nodes, edges).alias("graph"))).alias("value"))
    path = shared_path(spark, "json-graphs")
    documents.repartition("block").write.partitionBy("block").text(path)
    return path


def ends_of(g: Graph) -> DataFrame:
    """(source, segment, target): the edges by the names of their ends."""
    a, b = g.nodes.select(F.col("id").alias("a_"), F.col("name").alias("source"), "segment"), g.nodes.select(F.col("id").alias("b_"), F.col("name").alias("target"))
    return g.edges.join(a, F.col("src") == F.col("a_")).join(b, F.col("dst") == F.col("b_")).select("source", "segment", "target")


ENDS = "SELECT 'C' || c_custkey AS source, c_mktsegment AS segment, 'N' || c_nationkey AS target FROM customer"


@query("s5_sniff_delimiter", "SELECT * FROM (VALUES ('nation', ','), ('region', chr(9)), ('part', ';')) t(name, delimiter)")
def s5_sniff_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written with three delimiters below one folder."""
    path = shared_path(spark, "delimited")
    for name, delimiter in (("nation", ","), ("region", "\t"), ("part", ";")):
        X.table(spark, sf_dir, name).coalesce(1).write.csv(f"{path}/kind={name}", sep=delimiter, header=True)
    return readers.sniff_delimiter(spark, path).select(F.regexp_extract("file", "kind=([a-z]+)", 1).alias("name"), "delimiter")


@query("s6_read_json_graph", ENDS)
def s6_read_json_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ends_of(readers.read_json_graph(spark, customer_documents(spark, sf_dir)))


@query("s7_read_graphml", ENDS)
def s7_read_graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed documents, one for each thousand customer keys and one for the nations, read as one graph."""
    customers = X.table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 1000).alias("block"), "c_custkey", "c_nationkey", "c_mktsegment")
    node = F.format_string('<node id="C%d"><data key="d0">%s</data></node>', F.col("c_custkey"), F.col("c_mktsegment"))
    edge = F.format_string('<edge source="C%d" target="N%d"></edge>', F.col("c_custkey"), F.col("c_nationkey"))
    lines = customers.select("block", F.explode(F.array(node, edge)).alias("line"))
    lines = lines.union(customers.select(F.lit(-1).alias("block"), F.format_string('<node id="N%d"></node>', F.col("c_nationkey")).alias("line")).distinct())
    head, foot = '<graphml><key id="d0" for="node" attr.name="segment" attr.type="string"></key><graph edgedefault="directed">', "</graph></graphml>"
    documents = lines.groupBy("block").agg(F.concat_ws("\n", F.lit(head), F.concat_ws("\n", F.collect_list("line")), F.lit(foot)).alias("value"))
    path = shared_path(spark, "graphml")
    documents.repartition("block").write.partitionBy("block").text(path)
    return ends_of(readers.read_graphml(spark, path))


@query("r4_batch_job", "SELECT 'N' || c_nationkey AS name FROM customer GROUP BY 1 HAVING count(*) > 1")
def r4_batch_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations with two customers or more: a job over saved documents, by a file of parameters."""
    documents, to = customer_documents(spark, sf_dir), shared_path(spark, "batch")
    options = {"type": "json", "plugin.name": "remove_leaves", "plugin.parameters": {"limit": 1}, "destination": to}
    spark.createDataFrame([(json.dumps(options),)], "value string").coalesce(1).write.text(f"{to}-parameters")
    [saved] = batch.run(spark, f"{to}-parameters", [documents])
    return readers.read_graph_parquet(spark, saved)[0].nodes.select("name")
