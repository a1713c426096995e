"""Work that must not grow faster than its input: plan shapes and sizes of parts."""

from __future__ import annotations

import tracemalloc
import types

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom import scale
from textloom.functions import text as tx
from textloom.operators import arcs, clusters, conllu, counts, language, profile, similarity, tokens, trees
from textloom.plans import views


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trees_take_no_look_up_for_each_token(spark):
    """A look-up in an array for each token grows with the square of a sentence, and with the cost of an interpreted expression on short ones."""
    sents = spark.createDataFrame([(1, 0, ["DET", "NOUN", "AUX", "ADP", "DET", "ADJ"])], "doc_id LONG, sent_id INT, upos ARRAY<STRING>")
    rows = trees.with_tree(trees.with_baseline(sents))
    assert "lambdafunction" not in plan_of(rows)
    row = rows.select("dep", "head", "tree.*").first()
    assert row["dep"] == ["det", "nsubj", "ROOT", "prep", "det", "amod"]
    assert row["head"] == [1, 2, 2, 1, 5, 1]
    assert row["head_idx"] == [2, 3, 0, 2, 6, 2]


def test_trees_of_odd_sentences(spark):
    rows = spark.createDataFrame([
        (1, [], [], []), (2, ["NOUN"], ["ROOT"], [0]), (3, ["VERB", "ADP", "NOUN", "NOUN"], ["ROOT", "prep", "pobj", "pobj"], [0, 0, 1, 1]),
        (4, ["AUX", "ADJ", None], ["ROOT", "attr", None], [0, 0, None])], "doc_id LONG, upos ARRAY<STRING>, dep ARRAY<STRING>, head ARRAY<INT>")
    got = {r["doc_id"]: r for r in trees.with_tree(rows).select("doc_id", "tree.*").collect()}
    assert got[1]["head_idx"] == [] and got[2]["head_idx"] == [0] and got[2]["deprel"] == ["root"]
    assert got[3]["head_pp"] == [0, 4, 1, 1] and got[3]["deprel_pp"] == ["root", "case", "nmod", "nmod"]
    assert got[4]["head_idx"] == [2, 0, 0] and got[4]["deprel"] == ["cop", "root", None]


def test_parts_of_clustered_texts_stay_small(spark, tmp_path):
    """Tokens of a part are sorted and counted in one task: its texts must be few, whatever the table holds."""
    spark.range(400_000).select(F.col("id").alias("doc_id"), *[F.sha2((F.col("id") * 31 + i).cast("string"), 512).alias(f"text{i}") for i in range(4)]).write.parquet(
        str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    size = scale.scanned_bytes(rows)
    assert size > 2 ** 27
    assert size / scale.cluster_by(rows, "doc_id").rdd.getNumPartitions() <= 2 ** 23 + 2 ** 20


def test_language_scores_take_no_expression_for_each_character(spark, docs, monkeypatch):
    rows = language.detect_language(docs(("the cat and the dog", "en"), (None, "en"), ("", "en"), ("x", "en")))
    assert "aggregate(" not in plan_of(rows).split("_scores")[-1] and "split(" not in plan_of(rows)
    texts = ["the cat and the dog sat on it", "le chat et le chien", "a", "", "日本 語 text", "der Hund \U00010780 und", "x" * 500]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, text STRING").withColumn("l", language.letters(F.col("text")))
    profiles = language.default_profiles(frame)
    monkeypatch.setattr(language, "HELD_CHARACTERS", 20)  # texts are scored in several lots
    got = frame.orderBy("i").select(F.arrow_udf(language.scorer(profiles), "struct<sums:array<bigint>,n:int>")("l").alias("s"), language.trigram_slots(F.col("l")).alias("slots")).collect()
    for r in got:
        assert r["s"]["n"] == len(r["slots"])
        assert r["s"]["sums"] == [sum(profiles[name][k] for k in r["slots"]) for name in sorted(profiles)]


def test_inverted_file_finds_neighbours_of_vectors_without_clusters(spark):
    """Random vectors lie in no cells: a fixed number of cells found 0.78 of the neighbours in sf0.1."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    found, exact = clusters.ivf_search(asked, vectors, 10), similarity.topk_similar(asked, vectors, 10)
    both = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    assert both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] >= 0.9


def test_arcs_of_documents_shuffle_nothing(spark, docs):
    rows = docs(("The dog ran to the house. It was big!\nYes", "en"), ("", "en"), (None, "en"), ("Der Hund ist gross.", "de"), ("a b", None))
    got = trees.document_arcs(rows)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    cols = ["doc_id", "sent_id", "tok_id", "dep", "head_id"]
    want = trees.baseline_arcs(tokens.tokens(rows)).select(*cols)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect())) != []


def test_profiles_and_token_json_lay_the_tokens_out_once(spark, tmp_path):
    """Batches that pass through Python lose the layout: no exchange may stand above the tokens."""
    spark.createDataFrame([(i, "The dog ran to the house. It was big!", "en") for i in range(20)], "doc_id LONG, text STRING, lang STRING").write.parquet(str(tmp_path / "d"))
    rows = spark.read.parquet(str(tmp_path / "d"))
    sents = trees.document_sentences(scale.cluster_by(rows, "doc_id"), laid_out=True)
    counts = trees.exploded(sents, "doc_id").groupBy("doc_id", "dep").count()
    arcs = trees.baseline_arcs(tokens.tokens(rows)).groupBy("doc_id").agg(F.collect_list("dep"))
    for df in (counts, arcs):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    a = trees.document_sentences(rows).select("doc_id", "sent_id", "dep", "head").collect()
    b = sents.select("doc_id", "sent_id", "dep", "head").collect()
    assert sorted(a) == sorted(b)


def test_heads_of_token_tables_take_no_search_for_each_token(spark):
    """Each token searched the ids of its sentence, which were gathered anew for it; all columns of the table were gathered, after two sorts."""
    got = arcs.positions(pa.array([[5, 6, 9], [], [7, 7, 2], [None, 0]], pa.list_(pa.int32())), pa.array([[6, None, 4], [], [7, 8, 2], [0, None]], pa.list_(pa.int64())))
    assert got.to_pylist() == [[1, None, None], [], [0, None, 2], [1, None]]
    toks = views.annotated_tokens(spark, "/root/testdata/sf0.001")
    assert toks._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    plan = plan_of(conllu.conllu_export(annotations=toks, engine="annotated"))
    assert "array_position" not in plan and "struct(tok_id" in plan and "sent_pos, sent_pos" not in plan


def test_fields_of_tokens_are_settled_without_cutting_or_translating(spark):
    """Each token's line was cut to sort one pair at most, each cell translated, and each feature list built twice."""
    odd = ["", " ", "a", "!", "a b", "\u00a0", "\u00a0x", "x\u00a0", "a\tb", "\ta\n", "a\rb", "\u00e9t\u00e9", "a\u2003", "{}", "\x7f", None]
    rows = spark.createDataFrame([(v,) for v in odd], "v STRING")
    stripped = tx.strip(F.coalesce("v", F.lit("")))
    want = F.when(stripped == "", "_").otherwise(F.translate(stripped, "\t\n\r", "   "))
    assert rows.filter(~tx.conllu_field(F.col("v")).eqNullSafe(want)).count() == 0
    morphs = ["", None, "{}", "{A=1|b}", "A=1|PunctType=x|B=2", "PunctSide=Ini", "PunctType=Peri", "{{a=}}|x", "|", "A=|B"]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in morphs], "m STRING").select(tx.conllu_feats(F.col("m"))).collect()]
    assert got == ["_", "_", "_", "A=1", "A=1|B=2", "_", "_", "a=}}", "_", "A="]
    cells = lambda feats: "\t".join(["1", "a", "a", "X", "X", feats, "0", "dep", "_", "_"])
    lines = [cells("_"), cells("b=1|A=2"), cells("A=1"), "# b|a", "", cells("c|b|B|a")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "x STRING").select(tx.sort_feats(F.col("x"))).collect()]
    assert got == [cells("_"), cells("A=2|b=1"), cells("A=1"), "# b|a", "", cells("a|b|B|c")]
    assert plan_of(rows.select(tx.conllu_feats(F.col("v")).alias("f"))).count("array_join") == 1
    assert "when not contains" in plan_of(rows.select(tx.sort_feats(F.col("v")).alias("f"))).lower()


def test_searches_hold_few_scores_at_once(spark):
    """Scores of a batch with all queries, and distances of a batch to all candidate centres, were one matrix: 5 GB for 65,536 queries."""
    rng = np.random.default_rng(5)
    ids, x = rng.permutation(20_000), np.round(rng.normal(size=(20_000, 8)), 1)
    asked = x[:3000]
    held = types.SimpleNamespace(value=(np.arange(3000), similarity._unit_rows(pd.Series(list(asked)))))
    batches = [pd.DataFrame({"vec_id": ids[a:b], "vector": list(x[a:b])}) for a, b in ((0, 4), (4, 9), (9, 10_009), (10_009, 20_000))]
    tracemalloc.start()
    got = pd.concat(similarity._search(held, 10)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6, peak
    scores = np.round(similarity._unit_rows(pd.Series(list(asked[:50]))) @ similarity._unit_rows(pd.Series(list(x))).T, 9)
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :10]
    want = {(i, int(ids[j]), scores[i, j]) for i in range(50) for j in order[i]}
    assert {(int(r.query_id), int(r.vec_id), r.score) for r in got.itertuples() if r.query_id < 50} == want
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids[:2000], x)], "key LONG, vector ARRAY<DOUBLE>").coalesce(1)
    centers = np.round(rng.normal(size=(2000, 8)), 3)
    rows = vectors.collect()
    near = {r["key"]: (r["cluster"], r["distance"]) for r in clusters.assigned(vectors, centers).collect()}
    d = clusters.distances(np.array([r["vector"] for r in rows]), centers)
    assert near == {r["key"]: (int(c), e) for r, c, e in zip(rows, d.argmin(1), d.min(1))}
    assert [s.stop - s.start for s in similarity.blocks(2000, 2000)] == [524, 524, 524, 428]


def test_profiles_make_no_row_for_a_token(spark, docs, monkeypatch):
    """Six rows for each token were sorted to be counted; long documents are counted in lots of their own, with the same counts."""
    rows = docs(("The dog ran to the house. It was BIG! The House ran.\nYes", "en"), ("", "en"), (None, "en"), ("Der Hund ist gross. STRAßE", "de"), ("a b", None), ("...", "fr"))
    assert "posexplode" not in plan_of(profile.profiles(rows))
    got = profile.profiles(rows).select("doc_id", "pos.upos_counts", "keywords.keywords").orderBy("doc_id").collect()
    assert got[0]["upos_counts"] == {"AUX": 1, "DET": 3, "NOUN": 5, "PART": 1, "PRON": 1, "PROPN": 2, "PUNCT": 3}
    assert got[1]["upos_counts"] == {} == got[2]["upos_counts"] and got[1]["keywords"] == []
    sents = rows.select("lang", trees.sentence_arrays(F.array_compact(F.array("text"))).alias("s"), F.lit(4).cast("long").alias("n")).toArrow()
    lang, column, n = (sents.column(i).combine_chunks() for i in range(3))
    run = counts.counter(8, 2, {"lemmas": 2, "tagged": 1, "arcs": 2, "terms": 2}, {"en": {"the", "it"}}, {("en", "ran"): "run"})
    listed = lambda *parts: [{k: sorted(v, key=str) if k in ("tags", "deps") else v for k, v in r.items()} for r in run(*parts).to_pylist()]
    whole = listed(lang, column, n)
    monkeypatch.setattr(counts, "HELD_TOKENS", 3)
    assert listed(lang, column, n) == whole and listed(lang[:0], column[:0], n[:0]) == []
    assert whole[0]["lemmas"] == [{"lemma": "house", "n": 2}, {"lemma": "run", "n": 2}]
    assert whole[3]["arcs"] and whole[5] == {"tags": [{"upos": "PUNCT", "n": whole[5]["tags"][0]["n"]}], "lemmas": [], "tagged": [], "deps": whole[5]["deps"],
                                             "arcs": whole[5]["arcs"], "cells": [0.0] * 8, "terms": []}


def test_documents_without_tokens_need_no_annotations(spark):
    """One blank or null text ended the whole export; a text with tokens that the annotations lack still does."""
    rows = spark.createDataFrame([(1, "The dog ran.", "en"), (2, None, "en"), (3, "", "en"), (4, " \n\t", "de"), (None, "A cat.", "en")], "doc_id LONG, text STRING, lang STRING")
    toks = trees.baseline_arcs(tokens.tokens(rows))
    lines = conllu.conllu_export(rows, toks, engine="annotated").collect()
    assert {r["doc_id"] for r in lines} == {1, None} and len(lines) == 7 + 6
    with pytest.raises(Exception, match="no annotations of document 5"):
        conllu.conllu_export(rows.union(spark.createDataFrame([(5, "!", "en")], rows.schema)), toks, engine="annotated").collect()
