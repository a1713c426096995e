from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from textloom.llm import mixing, ngram_join, queries, toxicity
from textloom.llm.common import stored
from tests.conftest import SF
from tests.llm.test_decontamination import brute as overlaps
from tests.llm.test_ngram_join import brute as join_components
from tests.llm.test_sharding import brute as shards


def test_representatives(rows):
    pairs = [(5, "a b c d e f g h"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (None, "a b c d e f g h"), (7, None), (8, ""), (8, ""), (None, "q r"),
             (None, "q r"), (9, "other words here")]
    got = ngram_join.representatives(stored(rows(pairs), "test"))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(
        [(3, pairs[0][1]), (7, None), (8, ""), (8, ""), (None, "q r"), (9, "other words here")], key=str)


def solved(tokens, p, targets, grow, most):
    """(weighted squares, matrix, right side) of the best rates in the box, by coordinate descent from a corner: another way to the same minimum."""
    share = np.array(targets) / sum(targets)
    a = (tokens[:, None] * (p - share if grow else p)).T
    b = np.zeros(len(share)) if grow else share * tokens.sum()
    weight = np.linalg.pinv(a / np.maximum(tokens, 1e-300) @ a.T, rcond=1e-9, hermitian=True)
    r = np.full(len(tokens), most)
    left, curve = a @ r - b, np.einsum("ki,kl,li->i", a, weight, a)
    for _ in range(300):
        for i in np.flatnonzero(curve > 0):
            new = np.clip(r[i] - a[:, i] @ weight @ left / curve[i], 1.0 if grow else 0.0, most)
            left = left + a[:, i] * (new - r[i])
            r[i] = new
    return left @ weight @ left, a, b, weight


@pytest.mark.parametrize("targets,grow,most", [((0.3, 0.7), True, 8.0), ((0.8, 0.2), True, 8.0), ((0.6, 0.4), False, 8.0), ((1.0, 0.0), False, 8.0), ((0.2, 0.3, 0.5), False, 8.0),
                                               ((0.5, 0.2, 0.3), True, 8.0), ((0.05, 0.95), True, 1.5)])
def test_rates_meet_targets(spark, targets, grow, most):
    """Against an independent solver: the totals miss the targets by no more than the best rates in the box do."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.8, 0.6][:len(targets)], 400)
    tokens = rng.integers(0, 400, 400).astype(float)
    table = stored(spark.createDataFrame([(float(t), [float(v) for v in x]) for t, x in zip(tokens, p)], "tokens DOUBLE, p ARRAY<DOUBLE>"), "test")
    rate, total, want = mixing.fitted_rates(table, targets, grow, most)
    got = table.select("tokens", "p", rate.alias("r")).collect()
    r, t, q = np.array([x.r for x in got]), np.array([x.tokens for x in got]), np.array([x.p for x in got])
    assert r.min() >= (1 if grow else 0) and r.max() <= most
    np.testing.assert_allclose(r * t @ q, total, rtol=1e-9)
    np.testing.assert_allclose(want, np.array(targets) * (total.sum() if grow else (t @ q).sum()), rtol=1e-9)
    least, a, b, weight = solved(t, q, targets, grow, most)
    left = a @ r - b
    assert left @ weight @ left <= 1.25 * least + 1e-4 * t.sum()
    if least < 1e-6 * t.sum():  # within reach
        np.testing.assert_allclose(total, want, rtol=1e-3)


def test_mixing_odd_rows(spark, rows):
    labelled = spark.createDataFrame([(i, "high" if i % 3 else "low", 1) for i in range(60)] + [(None, "low", 1)], "doc_id LONG, domain STRING, p INT")
    pairs = [(i, "good words here" if i % 3 else "bad stuff") for i in range(60)] + [(None, "x"), (70, None), (71, ""), (5, "good words here")]
    docs = rows(pairs)
    rates, total, want = mixing.mixed(docs, labelled)
    got = rates.collect()
    assert len(got) == len(pairs) and all(abs(sum(r.p) - 1) < 1e-9 and r.rate >= 0 for r in got)
    np.testing.assert_allclose(total, want, rtol=1e-3)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    want_rows = Counter()
    for r in got:
        want_rows[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.repeated(docs, rates).collect()) == +want_rows
    assert mixing.mixed(rows([]), labelled)[0].count() == 0
    assert mixing.mixed(docs, labelled.limit(0))[0].count() == len(pairs)
    with pytest.raises(ValueError):
        mixing.mixed(docs, labelled, ("a", "b"), (1.0,))


def test_query(spark):
    got = queries.op8_soft_membership(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.n_tokens == len(docs[r.doc_id].split()) for r in got if docs[r.doc_id].isascii())
    high = sum(r.n_tokens * r.rate * r.p_high for r in got)
    assert abs(high / sum(r.n_tokens * r.rate for r in got) - mixing.TARGETS[1]) < 1e-4


def test_every_stage(spark):
    """Each stage against its brute-force version, on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        after = stored(stage(spark, docs, SF), "test")
        if name != "sharding":
            assert after.columns == columns
            kept = Counter(r.doc_id for r in after.select("doc_id").collect())
        if name == "toxicity":
            scored = toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
            assert kept == Counter(r.doc_id for r in scored if r.score < 0.5)
        elif name == "ngram_jaccard_join":
            assert kept == Counter(i for i, _, c in join_components(before) if i == c)
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = {i for i, _ in overlaps(before, items)}
            assert bad and kept == Counter(i for i, _ in before if i not in bad)
        elif name == "mixing":
            ids = Counter(i for i, _ in before)
            assert set(kept) == set(ids) and all(kept[i] >= n for i, n in ids.items()) and sum(kept.values()) > len(before)
        else:
            cols = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
            assert Counter(tuple(r[c] for c in cols) for r in after.collect()) == shards(before, 40)
        docs = after


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Jobs of toxicity and mixing that send texts or features to Python have bounded batches; the frames that the stages return send none."""
    seen, frame = [], type(spark.range(0))

    def noted(f, of):
        def call(self, *a, **b):
            if "InArrow" in of(self)._jdf.queryExecution().optimizedPlan().toString():
                seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
            return f(self, *a, **b)
        return call

    writer = type(spark.range(0).write)
    monkeypatch.setattr(frame, "first", noted(frame.first, lambda x: x))
    monkeypatch.setattr(writer, "parquet", noted(writer.parquet, lambda x: x._df))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.mix_quality):
        before = len(seen)
        out = stage(spark, docs, SF)
        assert "InArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert len(seen) >= before + 3 and max(seen) <= 1000  # features, training, scores
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000


def odd_documents(spark):
    """Rows of every kind, with columns named like those that stages add."""
    long = " ".join(f"w{k % 900}" for k in range(60_000))
    texts = ["plain words that nobody else has here", None, "", " \n ", "Tie tie TIE tie tie tie", long, "plain words that nobody else has here", "é 😀 ü", "x"]
    data = [(i if i != 6 else None, t, "en", "s", None if t is None else len(t)) + tuple(f"{c}{i}" for c in "abcdefgh") for i, t in enumerate(texts)]
    data += [data[0], data[0], data[2], data[6]]
    names = "score STRING, _rid STRING, rid STRING, _id STRING, hash STRING, copies STRING, n STRING, id STRING"
    return spark.createDataFrame(data, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars INT, " + names), len(set(texts))


def test_odd_rows_pass_all_stages(spark):
    """Null, empty, repeated, tied and very long rows, and columns with the names that stages use: none crashes, all columns come back as they were."""
    docs, _ = odd_documents(spark)
    columns, names = docs.columns, [c for c in docs.columns if c not in ("doc_id", "text")]
    rows_of = lambda df: Counter(tuple(r[c] for c in ("doc_id", "text", *names)) for r in df.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, SF), "test")
        assert after.columns == columns
        before, kept = rows_of(docs), rows_of(after)
        assert set(kept) <= set(before)
        if name == "ngram_jaccard_join":  # repeats of a set go, rows without words stay
            assert {t for _, t, *_ in kept} == {t for _, t, *_ in before} and all(n == 1 for r, n in kept.items() if r[1] and r[1].strip())
        elif name == "mixing":
            assert all(kept[r] >= n for r, n in before.items())
        else:
            assert kept == before
        docs = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and set(columns) - {"text"} <= set(out.columns) | set(names)


def test_empty_table(spark):
    docs, _ = odd_documents(spark)
    docs = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test")
        assert docs.count() == 0
