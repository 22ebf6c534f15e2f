"""The driver's contract: names, columns and results of queries against their SQL."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.adapters import TABLES
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 5) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted((tuple(cell(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = {c: k for k, c in enumerate(rel.columns)}
    want = sorted((tuple(cell(r[at[c]]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 25


def test_stands_without_the_training_data_operators(tmp_path):
    root = Path(entry.__file__).parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(q for q in e.queries() if q.startswith('op') or q == 'pipeline'))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "JAVA_HOME": ""})
    assert out.stdout.strip().splitlines()[-1].startswith("[]"), out.stderr[-500:]


def test_the_rest_passes_without_the_training_data_folders(tmp_path):
    """Both folders and the pipeline gone: the other tests are found, and one of them runs."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(root / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", "pytest.ini"):
        shutil.copy(root / name, tmp_path)
    run = lambda *a: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *a], cwd=tmp_path, capture_output=True, text=True)
    found = run("--collect-only", "tests")
    assert found.returncode == 0 and "test_scoring.py" in found.stdout, found.stdout[-500:]
    one = run("tests/test_contract.py", "-k", "test_query_equals_sql and action_bands")
    assert one.returncode == 0 and "1 passed" in one.stdout, one.stdout[-500:]
