import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ROWS_ONLY = ["de_linregress_cov", "cluster_cutoff", "cluster_ward", "feature_importance", "bootstrap_importance", "rfe_ranks", "train", "evaluate"]


def test_each_query_has_a_name_once_and_sql_belongs_to_one():
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_entry_gives_rows(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_queries_without_sql_give_rows(spark, name):
    e = importlib.import_module("__spark_entry__")
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", ["norm_mean", "norm_rt_window", "topn_sum", "maxlfq", "compare", "qvalue_counter", "enrich_overrep", "scan_diann"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    e, d = importlib.import_module("__spark_entry__"), "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "part", "embeddings", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.execute(e.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = e.queries()[name](spark, d).select(*[f"`{n}`" for n in names]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", ["diann_pivot", "diann_zero_null", "scan_diann"])
def test_reports_whose_order_leaves_ties_equal_their_sql(spark, tmp_path, name):
    """The first of lines with the same order and number counts, in the report's values and in its retention times."""
    import duckdb

    e, con, d = importlib.import_module("__spark_entry__"), duckdb.connect(), "/root/testdata/sf0.001"
    con.execute("SET threads = 1")
    con.execute(f"COPY (SELECT * REPLACE (1 AS l_orderkey, 1 AS l_linenumber) FROM '{d}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"COPY (SELECT * FROM '{d}/part.parquet') TO '{tmp_path}/part.parquet'")
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(e.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = e.queries()[name](spark, str(tmp_path)).select(*[f"`{n}`" for n in names]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", ["diann_qfilter", "diann_rt_median"])
def test_reports_of_long_orders_and_lines_without_order_equal_their_sql(spark, tmp_path, name):
    """An order's key counts a hundred times its line, so a line from 100 on may come after the next order's."""
    import duckdb

    e, con, d = importlib.import_module("__spark_entry__"), duckdb.connect(), "/root/testdata/sf0.001"
    con.execute("SET threads = 1")
    lines = "SELECT * REPLACE (CASE WHEN l_orderkey % 11 > 0 THEN l_orderkey END AS l_orderkey, l_linenumber * 5000 AS l_linenumber)"
    con.execute(f"COPY ({lines} FROM '{d}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"COPY (SELECT * FROM '{d}/part.parquet') TO '{tmp_path}/part.parquet'")
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(e.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = e.queries()[name](spark, str(tmp_path)).select(*[f"`{n}`" for n in names]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_the_rest_works_without_the_text_folders(tmp_path):
    for x in ("__spark_entry__.py", "quantloom"):
        subprocess.run(["cp", "-r", str(ROOT / x), str(tmp_path)], check=True)
    shutil.rmtree(tmp_path / "quantloom" / "llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op1') or q == 'pipeline' for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert int(said.stdout.split()[0]) > 100 and said.stdout.split()[1] == "False"
