import math
from collections import Counter

import numpy as np
import pytest

from textloom.llm import topk
from tests.llm.sql import same_as_sql


def brute(rows, asked, k):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in sorted(fine, reverse=True) if i in asked}.items():
        held = lambda s: max(-2**63, min(2**63 - 1, s))
        scored = sorted((-held(sum(a * b for a, b in zip(v, w))), i) for i, w in fine if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return Counter(out)


def run(spark, rows, asked, k=3, **more):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id LONG, embedding ARRAY<FLOAT>, score INT, v INT").repartition(3)
    return Counter(map(tuple, topk.top_k(df, df.filter(df.vec_id.isin(list(asked))), k, **more).collect()))


def test_odd_rows(spark):
    rows = [(0, [1.0, -0.5]), (1, [1.0, -0.5]), (1, [1.0, -0.5]), (2, [0.25]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, []), (8, [-3.0, 2.0, 9.0]), (9, [0.001, -0.001])]
    assert run(spark, rows, {0, 1, 2, 3, 7, 8}) == brute(rows, {0, 1, 2, 3, 7, 8}, 3)
    assert run(spark, [(1, [1.0])], {1}) == Counter() == run(spark, [], {1})


def test_large_components(spark):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate([[1e30, 1.0], [-1e30, 2.0], [2e9, 3e9], [3e9, 1e9], [1.0, 1.0]])]
    assert run(spark, rows, {0, 2, 4}) == brute(rows, {0, 2, 4}, 3)


@pytest.mark.parametrize("clustered", [True, False])
def test_random(spark, monkeypatch, clustered):
    """Many blocks, many query chunks, ties."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "QUERY_BYTES", 2000)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 6)) + (10 * rng.normal(size=(5, 6)))[rng.integers(0, 5, 700)] * clustered
    rows = [(i, [float(np.float32(round(x, 1))) for x in r]) for i, r in enumerate(v)]
    assert run(spark, rows, set(range(0, 700, 20)), 10) == brute(rows, set(range(0, 700, 20)), 10)


def test_query(spark):
    same_as_sql(spark, "op10_no_random_access")
