import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest

from textloom.llm import queries, toxicity


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_features_by_hand():
    owner, slot = toxicity.features(["One two, THREE", None, "one two three", "x", ""])
    assert sorted(slot[owner == 0]) == sorted(slot[owner == 2])
    assert [int((owner == i).sum()) for i in range(5)] == [3 + 2 + 1, 0, 6, 1, 0]
    assert len(toxicity.features([])[0]) == 0


def test_learns_words_and_keeps_weights_sparse(spark, rows):
    rng = random.Random(1)
    pairs, labels = [], []
    for i in range(1500):
        bad = i % 4 == 0
        text = rng.choices([f"w{k}" for k in range(400)], k=rng.randint(5, 200))
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["nasty", "vile", "foul"])
        pairs.append((i, " ".join(text)))
        labels.append((i, int(bad), "x"))
    pairs += [(5000, None), (5001, ""), (5001, ""), (None, "vile w1")]
    table = spark.createDataFrame([*labels, (3, 1, "x"), (7, None, "x"), (None, 1, "x")], "doc_id LONG, toxic INT, text STRING")
    docs = rows(pairs)
    got = toxicity.toxicity(docs, table).collect()
    assert len(got) == len(pairs)
    y = dict((i, t) for i, t, _ in labels)
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.97
    assert len({r.score for r in got if r.doc_id in (5000, 5001)}) == 1
    assert next(r for r in got if r.doc_id is None).predicted == 1
    assert len(toxicity.learn(docs, table).slots) < 300


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_without_two_classes(spark, rows, labels):
    table = spark.createDataFrame(labels, "doc_id LONG, toxic INT")
    got = toxicity.toxicity(rows([(1, "a b"), (2, "c")]), table).collect()
    assert len({r.score for r in got}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(rows([]), table).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op5_ftrl_toxicity(spark, sf).collect() if r.held_out and r.doc_id in y]
    score, truth = np.array([r.score for r in got]), np.array([y[r.doc_id] for r in got])
    assert auc(score, truth) > 0.97
    assert (score[truth == 0] >= 0.5).mean() < 0.01 and (score[truth == 1] >= 0.5).mean() > 0.7


def test_rare_words_weigh_the_same_wherever_their_rows_stand(spark):
    """Twelve rows among 1,500, spread over the table or next to each other."""
    rng = random.Random(5)
    data = []
    for i in range(1500):
        text, bad = rng.choices([f"w{k}" for k in range(400)], k=rng.randint(20, 60)), i % 10 == 0
        if bad:
            text[0] = "vile" if i % 120 == 0 else "foul" if 1200 <= i < 1330 else "nasty"
        data.append((i, " ".join(text), int(bad)))
    assert sum("vile" in t for _, t, _ in data) == 13 and sum("foul" in t for _, t, _ in data) == 11
    model = toxicity.fit(spark.createDataFrame(data, "key LONG, text STRING, label INT"))
    clean, vile, foul, nasty = model.score(["w1 w2 w3", "vile w2 w3", "foul w2 w3", "nasty w2 w3"])
    assert clean < 0.1 and min(vile, foul, nasty) > 0.5


def test_bound_on_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 20_000)
    data = [(i, f"w{i % 7} " * 3 + ("nasty" if i % 3 == 0 else "fine") + f" u{i}", int(i % 3 == 0)) for i in range(3000)]
    model = toxicity.fit(spark.createDataFrame(data, "key LONG, text STRING, label INT"))
    assert model.score(["w1 nasty"])[0] > 0.5 > model.score(["w1 fine"])[0]


def test_workers_need_no_installed_package(tmp_path):
    """The operators score on workers that cannot import this package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = f"""
import sys
sys.path.insert(0, {root!r})
from textloom.session import build_session
from textloom.llm import toxicity
spark = build_session("local[2]", **{{"spark.ui.enabled": "false"}})
here = lambda _: [__import__("importlib.util").util.find_spec("textloom") is None]
assert spark.sparkContext.parallelize([1], 1).flatMap(here).collect() == [True]
docs = spark.createDataFrame([(i, "bad word" if i % 3 else "good word") for i in range(60)], "doc_id LONG, text STRING")
labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id LONG, toxic INT")
print(toxicity.toxicity(docs, labels).filter("predicted = 1").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert got.stdout.strip() == "40", got.stderr[-2000:]
