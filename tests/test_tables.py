import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from textloom.functions import schema
from textloom.functions import vectors as vx
from textloom.operators import clusters, conllu, lexical, quality, runlog, similarity, tokens, trees
from textloom.scale import bounded_broadcast, top_k
from textloom.sources import readers, sinks
from textloom.streaming import jobs

LOG = "pos bigint, `case` string, analyzers string, language string, seconds double, success boolean"


@pytest.fixture()
def log(spark):
    return spark.createDataFrame([
        (0, "en_wiki_bge_m3", "embeddings", "en", 2.0, True), (1, "b", "embeddings,sentiment", "de", 1.0, True),
        (2, "c", "default", "en", 9.0, False), (3, "d", "default", "en", 1.0, True)], LOG)


def test_run_log(spark, log):
    s = runlog.run_summary(log).first()
    assert (s["total"], s["successful"], s["failed"], s["avg_time"], s["max_time"], s["all_success"]) == (4, 3, 1, 3.25, 9.0, False)
    e = runlog.run_extremes(log).first()
    assert (e["fastest_case"], e["slowest_case"]) == ("b", "en_wiki_bge_m3")
    by = {r["backend"]: r["count"] for r in runlog.run_by_backend(log).collect()}
    assert by == {"bge-m3": 1, "miniLM": 1}
    assert runlog.run_filter(log, failed_only=True).count() == 1
    assert runlog.run_filter(log, min_time=1.0, max_time=2.0, language="en").count() == 2
    assert runlog.run_filter(log, backend="BGE-M3").count() == 1
    c = runlog.run_compare(log, F.col("pos") >= 2).first()
    assert c["avg_time_improvement"] == round((1.5 - 5.0) / 1.5 * 100, 4) and c["success_rate_improvement"] == -50.0


def test_run_log_edges(spark, log):
    empty = log.filter("false")
    s = runlog.run_summary(empty).first()
    assert (s["total"], s["success_rate"], s["avg_time"]) == (0, 0.0, 0.0)
    assert runlog.run_extremes(log.filter("NOT success")).first()["fastest_case"] is None
    c = runlog.run_compare(log, F.lit(True)).first()
    assert c["avg_time_improvement"] == 0.0 and c["success_rate_improvement"] == 0.0


def test_run_log_files(spark, tmp_path):
    rec = {"timestamp": "2024-01-01T00:00:00", "case": "a", "source_file": "f", "language": "en", "analyzers": "default",
           "return_code": 0, "seconds": 1.5, "success": True, "error": "x"}
    (tmp_path / "one.json").write_text(json.dumps(rec))
    (tmp_path / "many.json").write_text(json.dumps([rec, {**rec, "success": False}], indent=1))
    assert readers.read_run_log(spark, str(tmp_path / "one.json")).count() == 1
    log = readers.read_run_log(spark, str(tmp_path / "many.json"))
    assert runlog.run_summary(log).first()["failed"] == 1
    sinks.write_run_log_csv(log, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == list(sinks.RUN_LOG_COLUMNS) and back.count() == 2


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\nline two")
    (tmp_path / "urls.lst").write_text("# list\n\n http://a.org \nhttp://b.org\n#x\n")
    (tmp_path / "none.lst").write_text("# only\n\n")
    (tmp_path / "pairs.jsonl").write_text('{"text1": "a", "text2": "b", "label": "similar"}\n\n{"text1": "c", "text2": "d", "label": "x"}\n')
    doc = readers.read_documents(spark, str(tmp_path / "a.txt")).first()
    assert doc["title"] == "a.txt" and doc["text"] == "line one\nline two" and doc["value"].startswith("/")
    named = readers.read_documents(spark, str(tmp_path / "*.txt"), key="path")
    assert named.first()["doc_id"] == doc["value"] and lexical.lexical_stats(named.withColumn("lang", F.lit("en"))).first()["doc_id"] == doc["value"]
    with pytest.raises(ValueError, match="hash"):
        readers.read_documents(spark, str(tmp_path / "a.txt"), key="name")
    assert [r["url"] for r in readers.read_url_list(spark, str(tmp_path / "urls.lst")).orderBy("line_no").collect()] == ["http://a.org", "http://b.org"]
    with pytest.raises(ValueError):
        readers.read_url_list(spark, str(tmp_path / "none.lst"))
    assert readers.read_pairs(spark, str(tmp_path / "pairs.jsonl")).count() == 2


def test_conllu_round_trip(spark, docs, tmp_path):
    d = docs(("The cats of Rome sleep. It is red!", "en"))
    rows = conllu.document_tokens(d)
    lines = conllu.header_lines(d).unionByName(conllu.conllu_export(d, engine="baseline"))
    sinks.write_conllu(lines, str(tmp_path / "c"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "c"), wholetext=False).collect())
    assert text.startswith("# NOTE") and "# sent_id = 0\n# text = The cats of Rome sleep.\n1\tThe\tthe\tDET" in text
    back = readers.read_conllu(spark, str(tmp_path / "c"))
    want = [(r["text"], r["upos"]) for r in rows.orderBy("sent_id", "idx").collect()]
    got = back.orderBy("tok_id").collect()
    assert [(r["text"], r["upos"]) for r in got] == want and {r["sent_id"] for r in got} == {0, 1}
    again = conllu.conllu_tokens(back).orderBy("sent_id", "idx").collect()
    assert [r["head_basic"] for r in again] == [r["head_idx"] for r in rows.orderBy("sent_id", "idx").collect()]


def conllu_file(seed, newdocs=True):
    """A file with ranges, empty nodes, comments, odd blank lines and several documents."""
    rng = random.Random(seed)
    out = ["# NOTE: made by hand"]
    for s in range(300):
        if newdocs and rng.random() < 0.04:
            out.append("# newdoc id = d%d" % s if rng.random() < 0.7 else "# newdoc")
            if rng.random() < 0.2:
                out += ["", ""]  # a document line that stands alone
        out.append(f"# sent_id = {s}")
        n = rng.choice([1, 2, 5, 30])
        for k in range(1, n + 1):
            if rng.random() < 0.1:
                out.append(f"{k}-{k + 1}\tdu" + "\t_" * 8)
            if rng.random() < 0.05:
                out.append(f"{k}.1\tnull" + "\t_" * 8)
            out.append(f"{k}\tw{s}é\t_\tNOUN\t_\t_\t{k - 1}\tdep\t_\t_")
        out += [rng.choice(["", "", "", " ", "\t"])] * rng.choice([1, 1, 2, 3])
    return out


def read_by_hand(lines, file):
    """(document name, sentence, position, token, text, head) in plain Python."""
    rows, name, doc, sent, tok, block = [], None, 0, 0, 0, []
    for line in [*lines, ""]:
        if line.startswith("# newdoc"):
            name, doc, sent, tok = (line.split(" = ")[1] if " = " in line else None), doc + 1, 0, 0
        if line.strip():
            block += [line] if line.split("\t")[0].isdigit() else []
        elif block:
            for k, x in enumerate(c.split("\t") for c in block):
                head = int(x[6])
                rows.append((doc, name or file, sent, k, tok + k, x[1], tok + k if head == 0 else tok + head - 1))
            sent, tok, block = sent + 1, tok + len(block), []
    return [r[1:] for r in sorted(rows)]


@pytest.mark.parametrize("seed,newdocs,end", [(1, True, "\n"), (2, False, "\n"), (3, True, "\r\n")])
def test_conllu_file_of_many_splits(spark, tmp_path, seed, newdocs, end):
    """One file, read by one task and by many, gives the same rows; windows line ends cannot be cut but are read."""
    lines = conllu_file(seed, newdocs)
    path = tmp_path / "big.conllu"
    path.write_bytes(end.join([*lines, ""]).encode())
    want = read_by_hand(lines, str(path))
    cols = ["doc_name", "sent_id", "sent_pos", "tok_id", "text", "head_id"]
    key = lambda r: (r["doc_id"], r["tok_id"])
    for size in ("128m", "3k", "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            df = readers.read_conllu(spark, str(path))
            if size != "128m":
                assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
            got = df.collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        by_doc = {}
        for r in sorted(got, key=key):
            by_doc.setdefault(r["doc_id"], []).append(tuple(r[c] for c in cols))
        assert sorted(x for rows in by_doc.values() for x in rows) == sorted(want)
        assert all([r[3] for r in rows] == list(range(len(rows))) for rows in by_doc.values())


def test_conllu_engines(spark, docs, tmp_path):
    """The engine is named; none stands in for the other."""
    d = docs(("The cats of Rome sleep.", "en"), ("It is red!", "en"))
    (tmp_path / "a.conllu").write_text("# text = The cats sleep\n1\tThe\tthe\tDET\tDT\tDefinite=Def\t2\tdet\t_\t_\n2\tcats\tcat\tNOUN\tNNS\t_\t3\tnsubj\t_\t_\n"
                                       "3\tsleep\tsleep\tVERB\tVBP\t_\t0\troot\t_\tSpaceAfter=No\n\n")
    toks = readers.read_conllu(spark, str(tmp_path / "a.conllu")).withColumn("doc_id", F.lit(0).cast("long"))
    lines = [r["line"] for r in conllu.conllu_export(annotations=toks, engine="annotated").orderBy("line_no").collect()]
    assert lines == ["# sent_id = 0", "# text = The cats sleep", "1\tThe\tthe\tDET\tDT\tDefinite=Def\t2\tdet\t_\t_", "2\tcats\tcat\tNOUN\tNNS\t_\t3\tnsubj\t_\t_",
                     "3\tsleep\tsleep\tVERB\tVBP\t_\t0\troot\t_\tSpaceAfter=No", ""]
    assert conllu.conllu_export(d.filter("doc_id = 0"), toks, engine="annotated").count() == 6
    with pytest.raises(Exception, match="no annotations of document 1"):
        conllu.conllu_export(d, toks, engine="annotated").collect()
    for args, said in (({"docs": d, "engine": "annotated"}, "needs a token table"), ({"annotations": toks, "engine": "baseline"}, "annotates documents"),
                       ({"docs": d, "engine": "auto"}, "one of annotated, baseline")):
        with pytest.raises(ValueError, match=said):
            conllu.conllu_export(**args)
    with pytest.raises(TypeError):
        conllu.conllu_export(d, toks)


def test_multi_word_lines(spark):
    words = spark.createDataFrame([(0, 0, 1, "de", "de", "ADP", None, "B=1", None, "case", " "), (0, 0, 2, "le", "le", "DET", "", "", 3, "det", "x\ty")],
                                  "doc_id bigint, sent_id int, word_id int, form string, lemma string, upos string, xpos string, feats string, "
                                  "head int, deprel string, misc string")
    ranges = spark.createDataFrame([(0, 0, 1, 2, "du")], "doc_id bigint, sent_id int, first_id int, last_id int, form string")
    sents = spark.createDataFrame([(0, 0, "du\tx")], "doc_id bigint, sent_id int, sentence string")
    rows = conllu.conllu_mwt_lines(words, ranges, sents).orderBy("sent_id", "kind", "pos").collect()
    assert [r["line"] for r in rows] == ["# sent_id = 0", "# text = du x", "1-2\tdu" + "\t_" * 8, "1\tde\tde\tADP\t_\tB=1\t0\tcase\t_\t_", "2\tle\tle\tDET\t_\t_\t3\tdet\t_\tx y", ""]


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [3.0, 4.0], 0), (1, [0.0, 0.0], 0), (2, [4.0, -3.0], 1)], "vec_id bigint, embedding array<float>, label int")
    unit = {r["vec_id"]: r["embedding"] for r in similarity.l2_normalize(rows).collect()}
    assert unit[0] == pytest.approx([0.6, 0.8]) and unit[1] == [0.0, 0.0]
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 0)], "left_id bigint, right_id bigint")
    got = {r["right_id"]: r["score"] for r in similarity.cosine_pairs(pairs, rows).collect()}
    assert got[1] == 0.0 and got[2] == pytest.approx(0.0) and got[0] == pytest.approx(1.0)
    assert spark.range(1).select(vx.norm(F.array(F.lit(3), F.lit(4))).alias("n")).first()["n"] == 5.0


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_search_is_exact(spark, limit):
    rng = np.random.default_rng(3)
    corpus, queries = rng.normal(size=(400, 8)), rng.normal(size=(20, 8))
    corpus[17] = corpus[5]
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "vec_id bigint, vector array<double>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in similarity.topk_similar(q, c, 5, query_bytes=limit).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(queries) @ unit(corpus).T, 9)
    for i in range(20):
        want = np.lexsort((np.arange(400), -scores[i]))[:5]
        assert [got[(i, r)] for r in range(1, 6)] == want.tolist()


@pytest.mark.parametrize("held", [50_000, 90])
def test_inverted_file(spark, monkeypatch, held):
    """Recall on clustered vectors; all cells asked gives the exact result; a cell that holds most vectors is cut in parts."""
    monkeypatch.setattr(clusters, "HELD_ROWS", held)
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 16))
    corpus = middles[rng.choice(12, 1500, p=[0.5, *[0.5 / 11] * 11])] + 0.3 * rng.normal(size=(1500, 16))
    corpus[700] = corpus[3]
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "vec_id bigint, vector array<double>").repartition(6)
    q = c.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    hits = lambda df: {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in df.collect()}
    exact = hits(similarity.topk_similar(q, c, 10))
    assert hits(clusters.ivf_search(q, c, 10, probes=10_000)) == exact
    some = clusters.ivf_search(q, c, 10, probes=8)
    found = {(k[0], v[0]) for k, v in hits(some).items()}
    assert len(found & {(k[0], v[0]) for k, v in exact.items()}) >= 0.9 * len(exact)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert clusters.ivf_search(q, c.limit(0), 10).count() == 0 == clusters.ivf_search(q.limit(0), c, 10).count()


def test_clusters(spark):
    """Well separated groups are found; layout does not matter; odd tables."""
    rng = np.random.default_rng(6)
    middles = np.eye(8)
    label = rng.integers(0, 8, 600)
    data = middles[label] + 0.05 * rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<double>")
    rows = {r["vec_id"]: r["cluster"] for r in clusters.cluster_vectors(df, 8).collect()}
    pairs = {(label[i], c) for i, c in rows.items()}
    assert len(rows) == 600 and len(pairs) == 8 == len({c for _, c in pairs})
    assert rows == {r["vec_id"]: r["cluster"] for r in clusters.cluster_vectors(df.repartition(7, "embedding"), 8).collect()}
    u = clusters.unit_vectors(df, "vec_id", "embedding")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    start = unit[:5].copy()
    centers = clusters.lloyd(u, start, 4)
    for _ in range(4):
        near = clusters.distances(unit, start).argmin(1)
        start = np.array([unit[near == k].mean(0) if (near == k).any() else start[k] for k in range(5)])
    np.testing.assert_allclose(centers, start, atol=1e-7)
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "vec_id bigint, embedding array<double>")
    assert {r["cluster"] for r in clusters.cluster_vectors(same, 3).collect()} == {0}
    assert clusters.cluster_vectors(df.limit(0), 3).count() == 0


def test_quality_fixtures(spark):
    ok = {"tool": "textloom", "version": "1", "language": {"code": "en", "confidence": 0.5, "model": "m"}, "analyzers": []}
    bad_types = {**ok, "version": 3, "language": {"code": 5, "confidence": "high", "model": "m"}, "analyzers": {}}
    bad_analyzer = {**ok, "analyzers": [{"name": "pos", "confidence": 2, "results": {}}]}
    two_shapes = {**ok, "analyzers": [{"name": "pos", "processing_time": 0, "confidence": 1, "results": {"upos_counts": {}, "label": "x"}},
                                      {"name": "sentiment", "processing_time": 0, "confidence": 0, "results": {"supported": False}}]}
    rows = spark.createDataFrame([(0, json.dumps(ok)), (1, json.dumps({"tool": "x"})), (2, json.dumps(bad_types)), (3, json.dumps(bad_analyzer)),
                                  (4, json.dumps(two_shapes)), (5, "{nope")], "doc_id bigint, payload string")
    got = {}
    for r in quality.payload_violations(rows).collect():
        got.setdefault(r["doc_id"], set()).add((r["path"], r["rule"]))
    assert got == {
        1: {("tool", "const"), ("version", "required"), ("language", "required"), ("analyzers", "required")},
        2: {("version", "type"), ("language.code", "type"), ("language.confidence", "type"), ("analyzers", "type")},
        3: {("analyzers[0].processing_time", "required"), ("analyzers[0].confidence", "maximum"), ("analyzers[0].results", "oneOf")},
        4: {("analyzers[0].results", "oneOf"), ("analyzers[1].results", "oneOf")},
        5: {("", "json")}}
    shapes = quality.analyzer_rows(rows)
    assert quality.result_shapes(shapes).filter("doc_id = 4 AND shape_ok").count() == 0
    assert quality.result_shapes(shapes, strict=False).filter("doc_id = 4 AND shape_ok").count() == 1
    report = {r["doc_id"]: r["valid"] for r in quality.validation_report(rows).collect()}
    assert report == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False}
    said = {r["doc_id"]: r["error_list"] for r in quality.validation_report(rows).collect()}
    assert said[0] == "" and said[5] == "json" and said[4] == "analyzers[0].results oneOf; analyzers[1].results oneOf"
    for job in (quality.payload_violations, quality.validation_report):
        plan = job(rows)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan


#: An order, with everything the compiler knows.
ORDER = {
    "$defs": {"money": {"type": "number", "exclusiveMinimum": 0, "maximum": 1000, "multipleOf": 0.5}, "line": {
        "type": "object", "required": ["sku", "price"], "additionalProperties": False,
        "properties": {"sku": {"type": "string", "pattern": "^[A-Z]{2}-[0-9]+$", "maxLength": 6}, "price": {"$ref": "#/$defs/money"}, "tags": {
            "type": "array", "items": {"type": "string", "minLength": 1}, "uniqueItems": True, "maxItems": 3}}}},
    "type": "object", "title": "Order", "minProperties": 1, "required": ["id", "lines"],
    "properties": {
        "id": {"type": ["integer", "string"]}, "kind": {"enum": ["a", 2, None, True, {"x": [1]}]}, "lines": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/line"}},
        "pair": {"type": "array", "prefixItems": [{"const": "p"}, {"type": "boolean"}], "items": {"type": "null"}},
        "who": {"anyOf": [{"required": ["name"]}, {"required": ["mail"]}], "not": {"required": ["ghost"]}, "allOf": [{"type": "object"}, {"maxProperties": 2}]},
        "some": {"contains": {"type": "integer", "minimum": 5}, "minContains": 2, "maxContains": 3}},
    "patternProperties": {"^x-": {"type": "string"}}, "additionalProperties": {"type": "number", "minimum": 0, "exclusiveMaximum": 10}}


def test_second_schema(spark):
    base = {"id": 1, "lines": [{"sku": "AB-1", "price": 2.5}]}
    cases = [
        ({}, set()), ({"id": "q", "kind": None, "x-y": "s", "more": 9.5}, set()), ({"kind": {"x": [1]}}, set()), ({"kind": True}, set()), ({"kind": 2.0}, set()),
        ({"pair": ["p", True, None, None], "some": [5, 1, 9], "who": {"name": 1}}, set()), ({"pair": ["p"]}, set()),
        ({"id": 1.5}, {("id", "type")}), ({"id": None}, {("id", "type")}), ({"kind": 1}, {("kind", "enum")}), ({"kind": False}, {("kind", "enum")}), ({"kind": "2"}, {("kind", "enum")}),
        ({"lines": []}, {("lines", "minItems")}), ({"lines": {}}, {("lines", "type")}),
        ({"lines": [{"sku": "AB-1", "price": 0}, {"sku": "ab-1", "price": 2000.25}]},
         {("lines[0].price", "exclusiveMinimum"), ("lines[1].sku", "pattern"), ("lines[1].price", "maximum"), ("lines[1].price", "multipleOf")}),
        ({"lines": [{"sku": "AB-12345", "price": "1", "size": 3}, 7, {}]},
         {("lines[0].sku", "maxLength"), ("lines[0].price", "type"), ("lines[0].size", "additionalProperties"), ("lines[1]", "type"), ("lines[2].sku", "required"),
          ("lines[2].price", "required")}),
        ({"lines": [{"sku": "AB-1", "price": 1, "tags": ["a", "a", "", 4]}]},
         {("lines[0].tags", "uniqueItems"), ("lines[0].tags", "maxItems"), ("lines[0].tags[2]", "minLength"), ("lines[0].tags[3]", "type")}),
        ({"pair": ["q", 1, 2]}, {("pair[0]", "const"), ("pair[1]", "type"), ("pair[2]", "type")}),
        ({"who": {"phone": 1}}, {("who", "anyOf")}), ({"who": {"name": 1, "ghost": 1, "z": 1}}, {("who", "not"), ("who", "maxProperties")}), ({"who": 4}, {("who", "type"), ("who", "not")}),
        ({"some": [5, 1]}, {("some", "contains")}), ({"some": [5, 6, 7, 8]}, {("some", "contains")}),
        ({"x-y": 1}, {("x-y", "type")}), ({"more": 10}, {("more", "exclusiveMaximum")}), ({"more": "1"}, {("more", "type")})]
    texts = [json.dumps({**base, **c}) for c, _ in cases] + ["[]", "3", "{}", "null", "nope"]
    want = [w for _, w in cases] + [{("", "type")}, {("", "type")}, {("", "minProperties"), ("id", "required"), ("lines", "required")}, {("", "type")}, {("", "json")}]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, payload string")
    found = [set() for _ in texts]
    for r in quality.payload_violations(rows, schema=json.dumps(ORDER)).collect():
        found[r["doc_id"]].add((r["path"], r["rule"]))
    assert [(t, f) for t, f in zip(texts, found)] == [(t, w) for t, w in zip(texts, want)]
    whole = schema.Schema(json.dumps(ORDER))
    holds = rows.select("doc_id", F.try_parse_json("payload").alias("d")).filter("d IS NOT NULL").select("doc_id", whole.holds(F.col("d")).alias("ok")).collect()
    assert all(r["ok"] == (not want[r["doc_id"]]) for r in holds)


@pytest.mark.parametrize("text,said", [('{"type": "objekt"}', "unknown type"), ('{"dependentRequired": {}}', "unsupported"), ('{"properties": {"a": {"if": {}}}}', "unsupported"),
                                       ('{"$defs": {"n": {"properties": {"next": {"$ref": "#/$defs/n"}}}}, "$ref": "#/$defs/n"}', "comes back"),
                                       ('{"$ref": "other.json"}', "leaves")])
def test_schemas_that_cannot_be_compiled(spark, text, said):
    with pytest.raises(ValueError, match=said):
        schema.Schema(text)


def test_types_and_properties_of_payloads(spark):
    """Values of a wrong kind anywhere make a payload invalid; whole floats are integers."""
    def payload(**more):
        entry = {"name": "lexical_stats", "processing_time": 0, "confidence": 1, "results": {"total_tokens": 5}, **more.pop("entry", {})}
        return json.dumps({"tool": "textloom", "version": "1", "language": {"code": "en", "confidence": 1, "model": "m"},
                           "analyzers": [entry], **more})
    good = [payload(), payload(content={"char_count": 5.0}), payload(entry={"results": {"keywords": [["a", 1.5]], "method": "x"}}),
            payload(entry={"results": {"upos_counts": {"NOUN": 2, "other": "x"}, "top_lemmas_by_upos": {"NOUN": [["a", 1]]}}}),
            payload(entry={"results": {"vector": [0.5, 1]}, "metadata": {"language": {"code": "en", "confidence": 0.5}}})]
    bad = [payload(language="en"), payload(source="x"), payload(content=[]), payload(timing="x"), payload(entry={"metadata": 3}),
           payload(entry={"metadata": {"language": {"confidence": 2}}}), payload(content={"char_count": 5.5}), payload(analyzers=["x"])]
    bad += [payload(entry={"results": r}) for r in (
        {"total_tokens": "many"}, {"total_tokens": -5}, {"label": 3}, {"label": "x", "score": 9}, {"label": "x", "scores": {"compound": -2}},
        {"upos_counts": []}, {"upos_counts": {"NOUN": -1}}, {"vector": [1, "a"]}, {"method": "x", "keywords": [["a"]]}, {"method": "x", "keywords": [[1, 2]]},
        {"counts_by_label": {"ORG": 1}, "examples_by_label": {"ORG": [1]}}, {"dep_counts": {"nsubj": 1.5}}, {"total_tokens": 1, "top_lemmas": "x"},
        {"flesch_reading_ease": None}, [])]
    rows = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, payload string")
    report = {r["doc_id"]: r["valid"] for r in quality.validation_report(rows).collect()}
    assert [k for k in range(len(good)) if not report[k]] == []
    assert [bad[k - len(good)] for k in range(len(good), len(report)) if report[k]] == []


def test_golden_diff(spark):
    a = spark.createDataFrame([(1, 0.1234564), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 0.1234561), (2, 3.0)], "k int, v double")
    assert {(r["k"], r["v"], r["side"]) for r in quality.golden_diff(a, b).collect()} == {(2, 2.0, "actual"), (2, 3.0, "golden")}


def test_broadcast_is_bounded(spark):
    small, big = spark.range(5).select((F.col("id") * 2).alias("id")), spark.range(100).withColumnRenamed("id", "x")
    assert "ResolvedHint" in bounded_broadcast(small, 10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in bounded_broadcast(big, 10)._jdf.queryExecution().analyzed().toString()


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 AS g", "id AS v")
    plan = top_k(df, ["g"], [F.desc("v")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_token_jobs_shuffle_the_text_only(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    plan = lexical.top_lemmas(tokens.tokens(d))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    plan = lexical.lexical_stats(d)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
    plan = conllu.conllu_tokens(trees.baseline_arcs(tokens.tokens(d)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Cartesian" not in plan and "Python" not in plan
    plan = conllu.conllu_export(d, engine="baseline")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Sort", "Join", "Python"))


def test_stream_picks_up_new_files_and_drops_late_rows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda rows: spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn(
        "ts", F.to_timestamp("ts"))
    make([(1, "2024-01-01 10:00:00", 1, "view", 2.0, ""), (2, "2024-01-01 11:00:00", 1, "error", 4.0, ""), (3, "2024-01-02 10:00:00", 1, "view", 1.0, "")]
         ).write.mode("append").parquet(src)
    first = jobs.stream_run_monitor(spark, src, out).collect()
    assert [(str(r["window_start"]), r["runs"], r["avg_seconds"], r["success_rate"]) for r in first] == [("2024-01-01 00:00:00", 2, 3.0, 0.5)]
    make([(4, "2024-01-01 12:00:00", 1, "view", 9.0, ""), (5, "2024-01-03 10:00:00", 1, "view", 3.0, "")]).write.mode("append").parquet(src)
    both = jobs.stream_run_monitor(spark, src, out).orderBy("window_start").collect()
    assert [(str(r["window_start"]), r["runs"]) for r in both] == [("2024-01-01 00:00:00", 2), ("2024-01-02 00:00:00", 1)]


def test_pacing_goes_on_over_batches(spark, tmp_path):
    """A second run continues from the state of the first; a host that was idle long enough is forgotten, which changes nothing."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def put(*rows):
        df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(src)

    put((3, "2024-01-01 10:00:05", 1, "view", 1.0, ""), (1, "2024-01-01 10:00:00", 1, "view", 1.0, ""), (2, "2024-01-01 10:00:00", 1, "view", 1.0, ""), (4, "2024-01-01 10:00:00", 2, "view", 1.0, ""))
    first = {r["event_id"]: (str(r["start_ts"]), r["waited_s"]) for r in jobs.stream_crawl_pacing(spark, src, out, spacing=10, idle=60).collect()}
    assert first == {1: ("2024-01-01 10:00:00", 0.0), 2: ("2024-01-01 10:00:10", 10.0), 3: ("2024-01-01 10:00:20", 15.0), 4: ("2024-01-01 10:00:00", 0.0)}
    put((5, "2024-01-01 10:00:21", 1, "view", 1.0, ""), (6, "2024-01-01 12:30:00", 2, "view", 1.0, ""))
    put((7, "2024-01-01 12:30:01", 1, "view", 1.0, ""), (8, "2024-01-01 12:30:02", 1, "view", 1.0, ""))
    rows = {r["event_id"]: (str(r["start_ts"]), r["waited_s"]) for r in jobs.stream_crawl_pacing(spark, src, out, spacing=10, idle=60).collect()}
    assert rows == first | {5: ("2024-01-01 10:00:30", 9.0), 6: ("2024-01-01 12:30:00", 0.0), 7: ("2024-01-01 12:30:01", 0.0), 8: ("2024-01-01 12:30:11", 9.0)}


def test_host_sessions(spark):
    v = spark.createDataFrame([("http://a/1", "2024-01-01 10:00:00"), ("http://a/2", "2024-01-01 10:10:00"), ("http://a/3", "2024-01-01 12:00:00")],
                              "url string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["visits"] for r in jobs.host_sessions(v).collect()) == [1, 2]
