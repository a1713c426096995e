"""Every registered query against its check SQL, on whole tables at the smallest scale."""

import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_points
from tests.conftest import SF

# Numbered operators and the pipeline have their tests in tests/llm.
QUERIES, ORACLES = ({k: v for k, v in found.items() if k != "pipeline" and not re.match(r"op\d+_", k)}
                    for found in (entry_points.queries(), entry_points.oracle_sql()))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    expected = con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(expected.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    at = [expected.columns.index(c) for c in cols]
    want = sorted(tuple(cell(r[i]) for i in at) for r in expected.fetchall())
    assert got == want
    assert got, "the query should find something in the test data"


def test_entry(spark):
    assert entry_points.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"payloads", "token_json", "cluster_vectors"}


def test_entry_points_without_the_optional_part(tmp_path):
    """A copy without the subpackage (and one without the pipeline too) imports and offers all other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/textloom", tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalog.QUERIES), sorted(e.oracle_sql()) == sorted(e.catalog.ORACLES))"
    for more in ([], ["corpus_pipeline.py"]):
        for name in more:
            (tmp_path / name).write_text("from textloom.llm import common\n")
        got = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
        assert got.stdout.strip() == "True True", got.stderr
