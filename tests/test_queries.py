"""Registered queries against their SQL."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["flagship_supply_degrees", "s4_read_delimited", "s8_read_graph_parquet", "k3_write_graph_parquet", "c5_bicor", "r1_pipeline", "s2_read_edge_list", "p6_detect_join_key", "m3_impute_row_interpolation", "m13_normalise_quantile", "c6_jaccard", "c10_knn_edges", "g5_first_edge_between", "t11_knn_edges", "b11_map_to_unit", "b13_import_attributes", "e1_enrichment", "q2_select", "p1_mixed_column_types", "p2_row_duplicates", "p7_graph_size_curve_of_lines", "m17_tokenise_digits", "c17_replace_column_annotations", "t8_core_of_supply", "t9_tree_of_users", "a1_pagerank_of_users", "r3_reused_prefix", "s7_read_graphml", "r4_batch_job"]


def rows(cursor_rows):
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted([tuple(map(clean, r)) for r in cursor_rows], key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    out = entry.queries()[name](spark, sf)
    assert sorted(out.columns) == sorted(columns)
    assert rows(tuple(r) for r in out.select(*columns).collect()) == rows(cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/weftgraph", tmp_path / "weftgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    # with and without the pipeline, which needs them
    for with_pipeline in (False, True):
        if with_pipeline and os.path.exists(f"{root}/corpus_pipeline.py"):
            shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
        said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
        assert said.stdout.split(" ", 1)[1].strip() == "[]" and int(said.stdout.split()[0]) > 100, said.stderr
