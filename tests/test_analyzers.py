import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from textloom import lexicons
from textloom.operators import assemble, conllu, embeddings, keywords, lexical, quality, readability, sentiment, tokens, trees
from textloom.plans import views


def test_lexical_by_hand(spark, docs):
    d = docs(("The children went home. Cats sleep!\n...", "en"), ("", "en"), ("the of", "en"), ("one", "xx"))
    rows = [r.asDict() for r in lexical.lexical_stats(d).orderBy("doc_id").collect()]
    assert rows[0]["total_tokens"] == 5 and rows[0]["unique_lemmas"] == 5 and rows[0]["sentences"] == 3
    assert rows[0]["avg_token_length"] == (8 + 4 + 4 + 4 + 5) / 5
    assert rows[0]["avg_sentence_length_tokens"] == 6 / 3
    assert rows[1]["total_tokens"] == 0 and rows[1]["type_token_ratio"] == 0.0 and rows[1]["sentences"] == 0
    assert rows[2]["total_tokens"] == 0 and rows[2]["avg_sentence_length_tokens"] == 2.0
    assert rows[3]["type_token_ratio"] == 1.0


def test_inline_and_token_statistics_agree(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = lexical.lexical_stats(d), lexical.lexical_stats_of_tokens(tokens.tokens(d))
    assert quality.golden_diff(a, b).count() == 0


def test_results_do_not_depend_on_layout(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    shuffled = d.repartition(7, "source").sortWithinPartitions(F.desc("doc_id"))
    for job in (lambda x: lexical.top_lemmas_by_upos(tokens.tokens(x)), readability.scores, lambda x: tokens.entities(x),
                lambda x: sentiment.valence_scores(x, sentiment.valence_table(spark, views.INVENTED_VALENCE))):
        assert quality.golden_diff(job(d), job(shuffled)).count() == 0


def test_ties(spark, docs):
    d = docs(("zeta alpha zeta alpha beta", "en"))
    toks = tokens.tokens(d)
    assert [r["lemma"] for r in lexical.top_lemmas(toks).orderBy("rank").collect()] == ["alpha", "zeta", "beta"]
    assert [r["lemma"] for r in lexical.top_lemmas_by_upos(toks).orderBy("rank").collect()] == ["zeta", "alpha", "beta"]


def test_caps(spark, docs):
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(6)]
    toks = tokens.tokens(docs((" ".join(words), "en")))
    assert lexical.top_lemmas(toks).count() == 20 and keywords.keywords_frequency(toks).count() == 20
    spans = tokens.entities(docs((" ".join(str(i) for i in range(15)), "en")))
    assert spans.count() == 15 and lexical.ner_examples(spans).count() == 10


def test_user_lexicon(spark, docs):
    own = spark.createDataFrame([("en", "cat", True, None, "NOUN"), ("en", "dogs", False, "dog", "NOUN")], lexicons.LEXICON_SCHEMA)
    rows = tokens.tokens(docs(("cat dogs", "en")), own).orderBy("tok_id").collect()
    assert [(r["is_stop"], r["lemma"]) for r in rows] == [(True, "cat"), (False, "dog")]


def test_entities(spark, docs):
    d = docs(("Mail a.b@c.org or see https://x.org/p now, 2024-01-02: $3.50 is 40 % of 12 MIT License abc12", "en"), ("none", "en"))
    spans = tokens.entities(d).orderBy("start").collect()
    assert [(s["label"], s["text"]) for s in spans] == [
        ("EMAIL", "a.b@c.org"), ("URL", "https://x.org/p"), ("DATE", "2024-01-02"), ("MONEY", "$3.50"), ("PERCENT", "40 %"),
        ("CARDINAL", "12"), ("LAW", "MIT License")]
    toks = {r["tok_id"]: r["text"] for r in tokens.raw_tokens(d).filter("doc_id = 0").collect()}
    for s in spans:
        assert "".join(toks[i] for i in range(s["start"], s["end"])) == s["text"].replace(" ", "")
    rows = lexical.ner_summary(d, tokens.entities(d)).orderBy("doc_id").collect()
    assert [(r["total_entities"], r["supported"]) for r in rows] == [(7, True), (0, False)]


def test_names_are_found_inside_longer_runs(spark, docs):
    """In any case, at any place of a run of capitals, across line breaks, of one word or many, from an own table."""
    d = docs(("The United States met In New York under the MIT license.", "en"), ("SAN\nFRANCISCO and newyork, New-York", "en"), ("", "en"), (None, "en"))
    found = [(r["doc_id"], r["label"], r["text"]) for r in tokens.entities(d).orderBy("doc_id", "start").collect()]
    assert found == [(0, "GPE", "United States"), (0, "GPE", "New York"), (0, "LAW", "MIT license"), (1, "GPE", "SAN FRANCISCO")]
    own = spark.createDataFrame([("paris", "GPE"), ("new york", "GPE"), ("New York Times", "ORG"), ("york times square", "LOC"), ("AT&T", "ORG"), ("route 66", "LOC"),
                                 ("", "X"), ("paris", "PER")], "name STRING, name_label STRING")
    d = docs(("Paris: the New York Times Square of AT&T on Route 66, paris", "en"), ("new york times york times square new york", "en"))
    found = [(r["doc_id"], r["start"], r["end"], r["label"], r["text"]) for r in tokens.entities(d, own).orderBy("doc_id", "start").collect()]
    assert found == [(0, 0, 1, "GPE", "Paris"), (0, 3, 6, "ORG", "New York Times"), (0, 8, 11, "ORG", "AT&T"), (0, 12, 14, "LOC", "Route 66"), (0, 15, 16, "GPE", "paris"),
                     (1, 0, 3, "ORG", "new york times"), (1, 3, 6, "LOC", "york times square"), (1, 6, 8, "GPE", "new york")]


@pytest.mark.parametrize("listed", [10_000, 3])
def test_names_against_a_walk_over_the_tokens(spark, docs, monkeypatch, listed):
    """Longest name first, from left to right, with a large table of names; also where its first tokens are too many for a test in the row."""
    import random
    monkeypatch.setattr(tokens, "LISTED", listed)
    rng = random.Random(4)
    vocab = [f"{a}{b}" for a in "abcdef" for b in "xyz"]
    names = {" ".join(rng.choices(vocab, k=rng.choice([1, 2, 2, 3, 4]))): rng.choice("AB") for _ in range(1500)}
    texts = [" ".join(rng.choices(vocab, k=rng.choice([0, 3, 200]))) for _ in range(40)]
    want = []
    for i, t in enumerate(texts):
        w, at = t.split(), 0
        while at < len(w):
            n = next((n for n in (4, 3, 2, 1) if at + n <= len(w) and " ".join(w[at:at + n]) in names), 0)
            if n:
                want.append((i, at, at + n, names[" ".join(w[at:at + n])]))
            at += n or 1
    own = spark.createDataFrame(sorted(names.items()), "name STRING, name_label STRING")
    spans = tokens.entities(docs(*[(t, "en") for t in texts]), own)
    assert [(r["doc_id"], r["start"], r["end"], r["label"]) for r in spans.orderBy("doc_id", "start").collect()] == want


def test_no_text_is_shuffled_for_entities(spark):
    plan = tokens.entities(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") <= 2 and "BroadcastHashJoin" in plan


def brute_yake(text):
    import re
    stop = set(lexicons.stop_words("en"))
    sents = [re.findall(r"[^\W\d_]+", s) for s in re.split(r"(?<=[.!?])\s+", text)]
    occ = {}
    for i, ws in enumerate(sents):
        for j, w in enumerate(ws):
            lw = w.lower()
            if lw in stop or len(lw) < 3:
                continue
            occ.setdefault(lw, []).append((i, j, w, ws[j - 1].lower() if j else None, ws[j + 1].lower() if j + 1 < len(ws) else None))
    tfs = [len(v) for v in occ.values()]
    mean = sum(tfs) / len(tfs)
    sd = math.sqrt(sum(t * t for t in tfs) / len(tfs) - mean * mean)
    out = {}
    for w, v in occ.items():
        tf = len(v)
        ids = sorted(x[0] for x in v)
        med = (ids[(tf - 1) // 2] + ids[tf // 2]) / 2
        case = max(sum(x[2].isupper() for x in v), sum(x[2][0].isupper() and x[1] > 0 for x in v)) / (1 + math.log(tf))
        side = lambda k: (len({x[k] for x in v if x[k]}) / n if (n := sum(x[k] is not None for x in v)) else 0)
        rel = 1 + (side(3) + side(4)) * tf / max(tfs)
        spread = len(set(ids)) / len(sents)
        s = rel * math.log(math.log(3 + med)) / (case + tf / (mean + sd) / rel + spread / rel)
        out[w] = round(tf * (1 + s) / s, 6)
    return out


def test_yake_against_brute_force(spark, docs):
    text = "Spark joins tables. Big Spark clusters join big tables fast! NASA runs Spark; tables grow. Clusters of NASA sleep."
    d = docs((text, "en"))
    got = {r["keyword"]: r["score"] for r in keywords.keywords_yake(keywords.sentence_words(d)).collect()}
    want = brute_yake(text)
    assert set(got) == set(want)
    for w in got:
        assert got[w] == pytest.approx(want[w], abs=2e-6)


def test_keywords_of_documents_and_of_token_tables_agree(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (keywords.keywords_yake(w) for w in (keywords.sentence_words(d), keywords.sentence_words_of_tokens(tokens.tokens(d))))
    assert quality.golden_diff(a, b).count() == 0 and a.count() > 1000


def test_readability_by_hand(spark, docs):
    r = readability.scores(docs(("The cat sat. The dog ran. A banana is yellow.", "en"), ("", "en"))).orderBy("doc_id").collect()
    w, s, y, c, p = 10, 3, 13, 33, 1  # letters: 6 * 3 + 1 + 6 + 2 + 6
    assert r[0]["words"] == w and r[0]["syllables"] == y
    assert r[0]["flesch_reading_ease"] == pytest.approx(206.835 - 1.015 * w / s - 84.6 * y / w, abs=1e-6)
    assert r[0]["flesch_kincaid_grade"] == pytest.approx(0.39 * w / s + 11.8 * y / w - 15.59, abs=1e-6)
    assert r[0]["smog_index"] == pytest.approx(1.043 * math.sqrt(30 * p / s) + 3.1291, abs=1e-6)
    assert r[0]["automated_readability_index"] == pytest.approx(4.71 * c / w + 0.5 * w / s - 21.43, abs=1e-6)
    assert r[0]["difficult_words"] == 2
    assert r[1]["flesch_reading_ease"] == 0.0
    label = readability.text_standard(readability.scores(docs(("The cat sat.", "en")))).first()["text_standard"]
    assert label.endswith("grade") and " and " in label


@pytest.mark.parametrize("n,want", [(1, "1st"), (2, "2nd"), (3, "3rd"), (11, "11th"), (12, "12th"), (21, "21st"), (-1, "-1th")])
def test_ordinal(spark, n, want):
    got = spark.range(1).select(readability.ordinal(F.lit(n)).alias("o")).first()["o"]
    assert got == want or n < 0


def test_sentiment_signs(spark, docs):
    d = docs(("I love this great, wonderful day. Amazing!", "en"), ("Terrible, awful and useless. I hate it.", "en"),
             ("The table has four legs.", "en"), ("not good", "en"), ("very good", "en"), ("good", "en"), ("", "en"), ("good GREAT", "en"),
             ("good great", "en"), ("good but bad", "en"), ("good!!!!!!", "en"), ("good!!!!", "en"))
    table = sentiment.valence_table(spark, lexicons.VALENCE)
    c = [r["compound"] for r in sentiment.valence_scores(d, table).orderBy("doc_id").collect()]
    assert c[0] > 0.5 and c[1] < -0.5 and -0.2 < c[2] < 0.2
    assert c[3] < 0 < c[5] < c[4] and c[6] == 0.0 and c[7] > c[8] and c[9] < 0 and c[10] == c[11] > c[5]
    labels = [r["label"] for r in sentiment.sentiment_label(d, table).orderBy("doc_id").collect()]
    assert labels[:3] == ["positive", "negative", "neutral"]
    none = sentiment.sentiment_with_fallback(d, None, None).first()
    assert none["supported"] is False and none["confidence"] == 0.0


def tree(spark, rows):
    """rows of (text, upos, dep, head) of one sentence, heads as positions."""
    data = [(0, 0, i, t, u, d, h, " ", False, t.lower(), u, "") for i, (t, u, d, h) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id bigint, sent_id int, tok_id int, text string, upos string, dep string, head_id int, "
                                       "ws string, is_space boolean, lemma string, xpos string, morph string")


def heads(df):
    return [(r["head_idx"], r["deprel"]) for r in df.orderBy("idx").collect()]


def test_adposition_reattachment(spark):
    t = tree(spark, [("books", "NOUN", "ROOT", 0), ("of", "ADP", "prep", 0), ("stone", "NOUN", "pobj", 1)])
    assert heads(conllu.conllu_tokens(t)) == [(0, "root"), (3, "case"), (1, "nmod")]


def test_root_adposition_makes_no_loop(spark):
    t = tree(spark, [("of", "ADP", "ROOT", 0), ("stone", "NOUN", "pobj", 0)])
    assert heads(conllu.conllu_tokens(t)) == [(0, "root"), (1, "obl")]


def test_copula(spark):
    t = tree(spark, [("it", "PRON", "nsubj", 1), ("is", "AUX", "ROOT", 1), ("red", "ADJ", "attr", 1), (".", "PUNCT", "punct", 1)])
    assert heads(conllu.conllu_tokens(t)) == [(3, "nsubj"), (3, "cop"), (0, "root"), (3, "punct")]


def test_space_tokens_are_renumbered(spark):
    t = tree(spark, [("a", "DET", "det", 2), (" ", "SPACE", "", 0), ("b", "NOUN", "ROOT", 2)])
    t = t.withColumn("is_space", F.col("text") == " ")
    rows = conllu.conllu_tokens(t).orderBy("idx").collect()
    assert [(r["idx"], r["text"], r["head_idx"]) for r in rows] == [(1, "a", 2), (2, "b", 0)]


def test_trees_of_documents_and_of_token_tables_agree(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    cols = ["doc_id", "sent_id", "idx", "text", "lemma", "upos", "xpos", "morph", "ws", "dep", "head_basic", "deprel_basic", "head_pp", "deprel_pp", "head_idx", "deprel"]
    a, b = conllu.document_tokens(d).select(*cols), conllu.conllu_tokens(trees.baseline_arcs(tokens.tokens(d))).select(*cols)
    assert quality.golden_diff(a, b).count() == 0
    lines = conllu.conllu_lines(trees.with_tree(trees.with_baseline(trees.gathered(tokens.tokens(d)))))
    assert quality.golden_diff(lines, conllu.conllu_export(d, engine="baseline")).count() == 0


def test_heads_outside_the_sentence(spark):
    """They leave a child of 0; the last of several objects keeps its adposition."""
    t = tree(spark, [("in", "ADP", "prep", 9), ("a", "NOUN", "pobj", 0), ("b", "NOUN", "pobj", 0), ("c", "VERB", "ROOT", 3)])
    assert heads(conllu.conllu_tokens(t)) == [(0, "case"), (1, "obl"), (1, "obl"), (0, "root")]
    t = tree(spark, [("in", "ADP", "prep", 3), ("a", "NOUN", "pobj", 0), ("b", "NOUN", "pobj", 0), ("c", "VERB", "ROOT", 3)])
    assert heads(conllu.conllu_tokens(t)) == [(3, "case"), (4, "nmod"), (4, "nmod"), (0, "root")]


def test_baseline_trees_are_rooted_and_acyclic(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 1500")
    rows = conllu.conllu_tokens(trees.baseline_arcs(tokens.tokens(d))).select("doc_id", "sent_id", "idx", "head_idx").collect()
    by_sentence = {}
    for r in rows:
        by_sentence.setdefault((r["doc_id"], r["sent_id"]), {})[r["idx"]] = r["head_idx"]
    assert len(by_sentence) > 100
    for sent in by_sentence.values():
        assert Counter(sent.values())[0] == 1
        for start in sent:
            seen, at = set(), start
            while at:
                assert at not in seen
                seen.add(at)
                at = sent[at]


def test_registry(spark):
    assert assemble.available_analyzers() == sorted(quality.ANALYZER_NAMES)
    with pytest.raises(ValueError):
        assemble.register_analyzer("pos")(lambda c: None)
    with pytest.raises(ValueError):
        assemble.register_analyzer("")
    with pytest.raises(KeyError):
        assemble.get_analyzer("nope")
    with pytest.raises(TypeError):
        embeddings.register_backend("x")(dict)
    with pytest.raises(ValueError):
        embeddings.register_backend("hashed-words")(type("Other", (embeddings.HashedWords,), {}))
    with pytest.raises(KeyError, match="hashed-words"):
        embeddings.get_backend("nope")


CHOICES = [
    ({}, ["dependency", "keywords", "lexical_stats", "ner", "pos", "readability"]),
    ({"enable": ["pos", "nope", "pos"]}, ["pos", "dependency"]),
    ({"enable": ["pos"], "disable": ["dependency"]}, ["pos", "dependency"]),
    ({"disable": ["keywords", "readability"]}, ["dependency", "lexical_stats", "ner", "pos"]),
    ({"enable": ["embeddings"], "with_sentiment": True}, ["sentiment", "dependency"]),
    ({"disable": ["embeddings", "pos"], "enable": ["pos", "ner"], "with_embeddings": True}, ["ner", "embeddings", "dependency"]),
    ({"enable": ["sentiment", "embeddings", "dependency"], "with_embeddings": True, "with_sentiment": True}, ["sentiment", "embeddings", "dependency"])]


def test_selection(spark):
    """The rule on lists, and the same rule on columns."""
    rows = spark.createDataFrame([(i, c.get("enable"), c.get("disable"), c.get("with_embeddings", False), c.get("with_sentiment", False)) for i, (c, _) in enumerate(CHOICES)],
                                 "i int, enable array<string>, disable array<string>, e boolean, s boolean")
    got = rows.select("i", assemble.chosen_analyzers(F.col("enable"), F.col("disable"), F.col("e"), F.col("s")).alias("names")).orderBy("i").collect()
    for (args, want), r in zip(CHOICES, got):
        assert assemble.select_analyzers(**args) == want == r["names"]


def rounded_json(x):
    if isinstance(x, dict):
        return {k: rounded_json(v) for k, v in x.items()}
    return [rounded_json(v) for v in x] if isinstance(x, list) else round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("own_lexicon", [False, True])
def test_fused_results_are_those_of_the_single_analyzers(spark, docs, own_lexicon):
    """All eight analyzers, on documents of all kinds, by one pass and one by one; a language without rules has no arcs; other analyzers join in."""
    import json
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 9 == 0, "it").otherwise(F.col("lang")).alias("lang"))
    d = d.filter("doc_id < 80").union(docs(("", "en"), ("...", "de"), (None, "fr"), ("A", "en")).select(F.col("doc_id") + 5000, "text", "lang"))
    d = d.withColumn("lang_confidence", F.lit(0.5))
    own = lexicons.lexicon(spark).filter("word <> 'the'") if own_lexicon else None
    corpus = assemble.Corpus(d, own)
    got = {(r["doc_id"], r["name"]): r for r in assemble.analyzer_results(corpus, assemble.available_analyzers()).collect()}
    for name in assemble.available_analyzers():
        for r in assemble.get_analyzer(name)(corpus).select("doc_id", "confidence", F.to_json("results").alias("j")).collect():
            one = got.pop((r["doc_id"], name))
            assert one["confidence"] == r["confidence"] and one["lang_confidence"] == 0.5 and one["processing_time"] is None
            assert rounded_json(json.loads(one["results"])) == rounded_json(json.loads(r["j"])), (r["doc_id"], name)
    assert not got
    arcs = {r["doc_id"]: json.loads(r["results"]) for r in assemble.analyzer_results(corpus, ["dependency"]).collect()}
    assert arcs[5000]["supported"] is False and set(arcs[5000]) == {"supported", "note"}
    assert all(arcs[i]["supported"] is own_lexicon for i in arcs if i < 5000 and i % 9 == 0)
    plan = assemble.payloads(corpus, d.select("doc_id", F.lit("").alias("source_type"), F.lit("").alias("source_value"), F.lit("").alias("domain"), F.lit("").alias("title"),
                                              F.length("text").alias("char_count"), F.lit(1).alias("word_count")), assemble.available_analyzers())
    if not own_lexicon:
        plan.collect()
        final = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("FileScan parquet") <= 3


def test_payloads_satisfy_the_contract(spark, docs, tmp_path):
    from textloom.sources import readers, sinks
    d = docs(("The children went to New York. It is red! Mail a@b.org, 12 times.", "en"), ("Der Hund und die Katze schlafen lange.", "de"),
             ("", "en")).withColumn("lang_confidence", F.lit(0.9))
    corpus = assemble.Corpus(d)
    content = d.select("doc_id", F.lit("file").alias("source_type"), F.lit("x.txt").alias("source_value"), F.lit("").alias("domain"),
                       F.lit("t").alias("title"), F.length("text").alias("char_count"), F.lit(3).alias("word_count"))
    out = assemble.payloads(corpus, content, assemble.select_analyzers(with_embeddings=True, with_sentiment=True))
    sinks.write_payloads(out, str(tmp_path / "p"))
    back = spark.read.text(str(tmp_path / "p")).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("payload"))
    assert back.count() == 3
    # The empty text has no arcs: its dependency result says so, and is no shape of the strict contract.
    assert [(r["path"], r["rule"]) for r in quality.payload_violations(back).collect()] == [("analyzers[0].results", "oneOf")]
    shapes = quality.result_shapes(quality.analyzer_rows(back))
    assert [r["name"] for r in shapes.filter("NOT shape_ok").collect()] == ["dependency"] and shapes.count() == 3 * 8
    assert quality.result_shapes(quality.analyzer_rows(back), strict=False).filter("NOT shape_ok").count() == 0
    assert quality.analyzer_coverage(back, quality.ANALYZER_NAMES).filter("passed").count() == 3
    doc = docs  # noqa: F841
    js = assemble.token_json(d, trees.baseline_arcs(tokens.tokens(d)), tokens.entities(d))
    sinks.write_token_json(js, str(tmp_path / "t"))
    toks = readers.with_stop_flags(readers.read_token_json(spark, str(tmp_path / "t")), "en")
    first = {r["tok_id"]: r for r in toks.filter("doc_id = 0").collect()}
    assert first[0]["text"] == "The" and first[0]["is_stop"] and "New York" != first[4]["text"]
    assert {r["ent_type"] for r in first.values()} == {"", "GPE", "EMAIL", "CARDINAL"}
    assert lexical.lexical_stats_of_tokens(toks).count() == 2


def test_summary_sink(spark, docs, tmp_path):
    from textloom.sources import sinks
    d = docs(("Good cats sleep.", "en")).withColumn("lang_confidence", F.lit(1.0))
    sinks.write_summary(assemble.analyzer_summary(assemble.Corpus(d), ["lexical_stats", "ner"]), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {"name", "confidence", "metadata.model", "metadata.language", "results.total_tokens", "results.total_entities"} <= set(back.columns)
    assert back.count() == 2
