"""Every registered shape query against DuckDB, and the entry module's contract."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from shapeloom import queries as registered

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query(spark, duck, name):
    result = registered.queries()[name](spark, SF)
    cols = sorted(result.columns)
    got = sorted(repr(tuple(r)) for r in result.select(cols).collect())
    cursor = duck.execute(registered.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cursor.fetchall())
    assert cols == sorted(names) and got == want and got


def test_every_query_has_sql():
    assert set(registered.queries()) == set(registered.oracle_sql())


def test_entry_without_optional_parts(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q), q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": ""})


def test_nothing_else_imports_the_optional_part():
    for f in (ROOT / "shapeloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert ".llm" not in f.read_text(), f
