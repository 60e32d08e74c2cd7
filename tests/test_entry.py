"""The driver's contract, and SQL comparisons of a few queries of each kind."""

import importlib
import os
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHOSEN = ["norm_punct", "normalized_views", "index_postings", "retrieve_topk", "sim_ratio", "threshold_sweep", "assemble_matches", "recall_at_k", "eda_match_stats", "tsv_roundtrip"]


@pytest.fixture(scope="module")
def entry_module():
    return importlib.import_module("__spark_entry__")


def cell(v):
    return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHOSEN)
def test_sql(spark, small, entry_module, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    a, b = entry_module.queries()[name](spark, small), con.sql(entry_module.oracle_sql()[name])
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    left = sorted(tuple(map(cell, r)) for r in a.select(*cols).collect())
    right = sorted(tuple(map(cell, r)) for r in b.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    assert left == right and left


def test_entry(spark, entry_module):
    assert entry_module.entry(spark).count() > 0


def test_registry(entry_module):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_imports_without_the_removable_parts(tmp_path):
    """A copy without the llm folders and the pipeline still imports and has its other queries."""
    copy = tmp_path / "copy"
    subprocess.run(["cp", "-r", f"{ROOT}/kinspark", f"{ROOT}/__spark_entry__.py", "--parents", str(tmp_path)], check=True)
    copy = str(tmp_path) + ROOT
    subprocess.run(["rm", "-rf", f"{copy}/kinspark/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'retrieve_topk' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
