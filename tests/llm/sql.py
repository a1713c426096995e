"""Comparison of a registered query with its check SQL on whole tables."""

import duckdb

from textloom.llm import queries
from tests.conftest import SF

TABLES = "documents embeddings pages benchmark labels conversations".split()


def same_as_sql(spark, name, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, expected = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(expected.columns)
    at = [expected.columns.index(c) for c in cols]
    got = sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(repr(r[i]) for i in at) for r in expected.fetchall())
    assert got == want and got
