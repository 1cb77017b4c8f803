"""Each query with SQL gives what DuckDB gives for it."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from quirelake.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    df = catalog.queries()[name](spark, DATA)
    want = oracle.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), columns)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["page", "color_ratio", "text_ratio", "gray_ratio", "type"] and df.count() == 500


CORE = "import __spark_entry__ as e; q = e.queries(); n = sum(not (x.startswith('op') or x == 'pipeline') for x in q); assert n == {core} == len(q) - {more}, (n, len(q)); e.oracle_sql(); e.entry"


def copied(to):
    """The whole repository, but for its history."""
    here = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(here, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    return here


def run_in(folder, more):
    code = CORE.format(core=len(catalog.queries()), more=more)
    subprocess.run([sys.executable, "-c", code], cwd=folder, check=True, env=os.environ | {"PYTHONPATH": str(folder)})


@pytest.mark.parametrize("keep_pipeline", [True, False])
def test_imports_without_optional_parts(tmp_path, keep_pipeline):
    copied(tmp_path / "r")
    for x in ("quirelake/llm", "tests/llm"):
        shutil.rmtree(tmp_path / "r" / x, ignore_errors=True)
    if not keep_pipeline:
        (tmp_path / "r" / "corpus_pipeline.py").unlink(missing_ok=True)
    run_in(tmp_path / "r", 0)


def test_a_missing_library_takes_only_its_own_queries(tmp_path):
    here = copied(tmp_path / "r")
    if not os.path.isdir(f"{here}/quirelake/llm"):
        pytest.skip("no corpus operators here")
    (tmp_path / "r" / "xxhash.py").write_text("raise ImportError('no xxhash')")
    found = __spark_entry__.queries()
    gone = 3  # op1, op4 and the pipeline
    run_in(tmp_path / "r", len(found) - len(catalog.queries()) - gone)
