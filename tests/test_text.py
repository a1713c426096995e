from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from textloom import lexicons
from textloom.functions import text as tx
from textloom.operators import extract, language, sentiment, tokens
from textloom.plans import views
from textloom.session import shared_dir
from textloom.sources import readers


def one(spark, value, fn, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("code,want", [
    ("en-US", "en"), ("EN_us", "en"), (" d e ", "de"), ("fre", "fr"), ("eng", "en"), ("xyz", "en"), ("", "en"),
    (None, "en"), ("it", "it"), ("english", "en")])
def test_normalize_lang(spark, code, want):
    assert one(spark, code, tx.normalize_lang) == want


@pytest.mark.parametrize("html,text,title", [
    ("<html><title> A &amp; B </title><script>x<1</script><p>one</p><!-- no --><noscript>n</noscript>two</html>", "A & B one two", "A & B"),
    ("<p>no title</p>", "no title", "Untitled"),
    ("<title></title>x", "x", ""),
    ("<STYLE>p{}</STYLE>a\n\n b", "a b", "Untitled")])
def test_html(spark, html, text, title):
    assert one(spark, html, tx.html_to_text) == text
    assert one(spark, html, tx.page_title) == title


@pytest.mark.parametrize("url,domain,path", [
    ("http://user@www.a.com:80/x?y#z", "user@www.a.com:80", "/x?y"), ("https://a.org", "a.org", "/"), ("notes.txt", "", "/"),
    ("//b.net/q", "b.net", "/q")])
def test_url(spark, url, domain, path):
    assert one(spark, url, tx.url_domain) == domain
    assert one(spark, url, tx.url_path) == path


def test_slug_and_key(spark):
    assert one(spark, " -a b/ü!- ", tx.slug) == "a-b-ü"
    assert one(spark, "!!", tx.slug) == "output"
    assert one(spark, "http://www.ex.com/a", lambda u: tx.output_key(u, F.lit(7))) == "ex-com_7"
    assert one(spark, "plain", lambda u: tx.output_key(u, F.lit(7))) == "url_7"


def test_counts_are_unicode_aware(spark):
    assert one(spark, "a b  c\n", tx.word_count) == 3
    assert one(spark, "", tx.word_count) == 0


def test_sentences(spark):
    text = "  One two.  Three!\n\nFour 3.5 five? six"
    assert one(spark, text, tx.sentences) == ["One two.", "Three!", "Four 3.5 five?", "six"]
    assert one(spark, " \n ", tx.sentences) == []


def test_tokens_rebuild_the_text(spark, docs):
    text = " \n Hé said: \"3 x\".  \n\n Next\tone 😀 ok"
    d = docs((text, "en"))
    rows = tokens.char_offsets(d, tokens.raw_tokens(d)).orderBy("tok_id").collect()
    assert [r["text"] for r in rows] == ["Hé", "said", ":", '"', "3", "x", '"', ".", "Next", "one", "😀", "ok"]
    assert [r["sent_id"] for r in rows] == [0] * 8 + [1] * 4
    for r in rows:
        assert one(spark, text, lambda t, r=r: F.substring(t, r["char_idx"] + 1, len(r["text"]))) == r["text"]
    assert [r["ws"] for r in rows[:5]] == [" ", "", " ", "", " "]


PROBES = {
    "en": ["Today the weather is nice and we go to the beach with the whole family.", "Natural language processing is a subfield of linguistics and computer science."],
    "de": ["Heute ist schönes Wetter und wir gehen mit der ganzen Familie an den Strand.", "DER HUND SCHLÄFT IM GARTEN, WEIL ES WARM IST."],
    "es": ["Hoy hace buen tiempo y vamos a la playa con toda la familia.", "El perro come en la cocina, pero el gato no quiere nada."],
    "fr": ["Aujourd'hui il fait beau et nous allons à la plage avec toute la famille.", "Le chien mange dans la cuisine parce qu'il pleut."],
    None: ["L'Italia è una repubblica e la sua capitale è Roma, dove vivono quasi tre milioni di persone.", "Oggi il tempo è bello e andiamo al mare con tutta la famiglia.",
           "Сегодня хорошая погода, и мы идем гулять в парк.", "Hoje está um dia bonito e vamos à praia com toda a família.", "Vandaag is het mooi weer en gaan we naar het strand.",
           "Idag är vädret fint och vi går till stranden med hela familjen.", "Dzisiaj jest ładna pogoda i idziemy na plażę.", "Σήμερα ο καιρός είναι καλός", "今日は天気がいいです"],
}


def test_language_probes(spark, docs):
    """Supported languages are told apart; others are English with 0.6 at most, also as long texts."""
    cases = [(t, want) for want, texts in PROBES.items() for x in texts for t in (x, " ".join([x] * 8))]
    rows = language.detect_language(docs(*[(t, "x") for t, _ in cases])).orderBy("doc_id").collect()
    for (t, want), r in zip(cases, rows):
        assert r["language"] == (want or "en"), t
        c = r["language_confidence"]
        assert 0 < c <= 0.6 if want is None else c > (0.9 if len(t) > 200 else 0.7), t


def test_language_rules(spark, docs):
    long_en = "the cat and the dog " * 20
    rows = language.detect_language(docs(("", "x"), (None, "x"), (" \n", "x"), ("123 %&", "x"), (long_en, "x"), ("der und die das " * 20, "x"))).orderBy("doc_id").collect()
    assert [(r["language"], round(r["language_confidence"], 4)) for r in rows] == [
        ("en", 0.0), ("en", 0.0), ("en", 0.0), ("en", 0.3), ("en", 1.0), ("de", 1.0)]


def test_short_text_boundary(spark, docs):
    text = "the house and the garden of the people who live there and have always lived there with their children and friends, and so on "
    a, b = (text + "q" * (n - len(text)) for n in (199, 200))
    rows = language.detect_language(docs((a, "x"), (b, "x"))).orderBy("doc_id").collect()
    assert abs(rows[0]["language_confidence"] / rows[1]["language_confidence"] - 0.8) < 0.01 and rows[1]["language_confidence"] > 0.9


def test_own_profiles(spark, docs):
    """Profiles of another pair of languages, with their own supported set; ties go to the first name."""
    samples = spark.createDataFrame([("aa", "lala lalo lola"), ("bb", "kiki kiku kuki"), ("bb", "kukuki")], "lang STRING, text STRING")
    profiles = language.learn_profiles(samples)
    assert sorted(profiles) == ["aa", "bb"] and all(len(w) == language.SLOTS for w in profiles.values())
    rows = language.detect_language(docs(("lola lala " * 30, "x"), ("kuki", "x")), profiles, ("aa",)).orderBy("doc_id").collect()
    assert (rows[0]["language"], rows[1]["language"]) == ("aa", "en") and rows[0]["language_confidence"] > 0.99 and rows[1]["language_confidence"] <= 0.6


def test_precedence(spark, docs):
    long_de = "und der die das " * 20
    d = language.detect_language(docs((long_de, "x"), (long_de, "x"), (long_de, "x")))
    over = F.when(F.col("doc_id") == 0, "FRA").otherwise("  ")
    default = F.when(F.col("doc_id") < 2, "es_MX")
    rows = language.resolve_language(d, over, default).orderBy("doc_id").collect()
    assert [(r["language"], round(r["language_confidence"], 4)) for r in rows] == [("fr", 1.0), ("es", 1.0), ("de", 1.0)]


def test_validity_boundaries(spark):
    rows = spark.createDataFrame([("123456789", "t"), ("1234567890", "t"), (" 12345678 \n", "t"), ("", ""), (None, None)], "text string, title string")
    got = [(r["is_valid"], r["reason"]) for r in extract.with_validity(rows, text=F.col("text"), title=F.col("title")).collect()]
    assert got == [(False, "text_too_short"), (True, ""), (False, "text_too_short"), (False, "title_empty,text_empty,text_too_short"),
                   (False, "title_empty,text_empty,text_too_short")]


def test_embedded_json(spark):
    get = lambda s: one(spark, s, lambda x: tx.embedded_json(x, '"tool": "t"'))
    assert get('noise {a} {"tool": "t", "n": {"k": 1}} tail') == '{"tool": "t", "n": {"k": 1}}'
    assert get('noise {"n": 1} tail') == '{"n": 1}'
    assert get("noise") is None and get("{broken") is None and get("} {") is None


def test_redact(spark):
    assert one(spark, "key abc and abc", lambda x: tx.redact(x, F.lit("abc"))) == "key ***REDACTED*** and ***REDACTED***"
    assert one(spark, "key", lambda x: tx.redact(x, F.lit(""))) == "key"


def test_conllu_cells(spark):
    assert one(spark, " a\tb\n", tx.conllu_field) == "a b"
    assert one(spark, " ", tx.conllu_field) == "_" and one(spark, None, tx.conllu_field) == "_"
    assert one(spark, "PunctType=Peri|Case=Nom|x", tx.conllu_feats) == "Case=Nom"
    assert one(spark, "PunctSide=Ini", tx.conllu_feats) == "_"
    line = "1\ta\ta\tX\tX\tb=1|A=2\t0\troot\t_\t_"
    assert one(spark, line, tx.sort_feats) == "1\ta\ta\tX\tX\tA=2|b=1\t0\troot\t_\t_"
    for other in ("# text", "", "1\t2\t3"):
        assert one(spark, other, tx.sort_feats) == other


def test_robots_first_rule_decides(spark):
    pages = spark.createDataFrame([(1, "http://h/a/b"), (2, "http://h/a"), (3, "http://h/c"), (4, "http://other/a")], "page_id bigint, url string")
    rules = extract.rules_table(spark, [("h", 2, "/a", False), ("h", 1, "/a/b", True)])
    allowed = {r["page_id"]: r["allowed"] for r in extract.robots_filter(pages, rules).collect()}
    assert allowed == {1: True, 2: False, 3: True, 4: True}
    assert extract.robots_filter(pages, rules, policy="ignore").filter("NOT allowed").count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_many_rules_on_one_host(spark, monkeypatch, broadcast):
    """100,000 rules of one host against a walk over all of them; also where nothing may be broadcast."""
    import random
    from textloom import scale
    if not broadcast:
        monkeypatch.setattr(extract, "bounded_broadcast", lambda df: scale.bounded_broadcast(df, 0))
    rng = random.Random(3)
    part = lambda: "/" + rng.choice("abcdefghij") * rng.randint(1, 3)
    data = [("big", s, "".join(part() for _ in range(rng.randint(1, 6))), rng.random() < 0.5) for s in range(100_000)] + [("small", 1, "", False), ("small", 0, "/x", True)]
    paths = ["".join(part() for _ in range(rng.randint(0, 7))) or "/" for _ in range(400)]
    pages = spark.createDataFrame([(i, f"http://big{p}") for i, p in enumerate(paths)] + [(900, "http://small/y"), (901, "http://small/xy"), (902, "http://none/a"), (903, None)],
                                  "page_id bigint, url string")
    first = {}
    for _, s, prefix, allow in reversed(data[:100_000]):
        first[prefix] = (s, allow)
    want = {i: min((first[p[:n]] for n in range(len(p) + 1) if p[:n] in first), default=(0, True))[1] for i, p in enumerate(paths)}
    want |= {900: False, 901: True, 902: True, 903: True}
    rules = extract.rules_table(spark, data)
    assert {r["page_id"]: r["allowed"] for r in extract.robots_filter(pages, rules).collect()} == want


def test_crawl_plan_of_a_hot_host(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://', if(id % 3 = 0, 'x', 'hot'), '/', id) AS url")
    from textloom.scale import ordered_rank
    rows = ordered_rank(pages.select("page_id", tx.url_domain(F.col("url")).alias("host")), "host", "page_id", "n", chunk=100)
    from pyspark.sql import Window
    plain = F.row_number().over(Window.partitionBy("host").orderBy("page_id"))
    assert rows.withColumn("m", plain).filter("n <> m").count() == 0
    last = extract.crawl_plan(pages, requests_per_second=0.001).orderBy(F.desc("start_offset_s")).first()
    assert last["start_offset_s"] == 1999 * 100.0


def test_default_lists_hold_no_filler_words(spark):
    """Prepositions and conjunctions that neither raise, damp nor contrast change no score."""
    texts = ["see food good"] + [f"{w} see food good" for w in ("from", "at", "as", "dem", "con", "avec", "para", "sur", "als", "dans")]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    got = sentiment.scored_words(rows, sentiment.valence_table(spark, lexicons.VALENCE)).filter("micro IS NOT NULL").select("micro").distinct()
    assert got.count() == 1
    raised = sentiment.scored_words(rows, sentiment.valence_table(spark, lexicons.VALENCE), boosters={"from": 0.5})
    assert raised.filter("micro IS NOT NULL").select("micro").distinct().count() == 2
    assert not set(views.INVENTED_VALENCE) & set(lexicons.POLARITY)


def test_url_list_blanks(spark, tmp_path):
    (tmp_path / "u.txt").write_text("http://a/\n\t# note\n\t\n  http://b/ \n#x\n")
    assert [r.url for r in readers.read_url_list(spark, str(tmp_path / "u.txt")).collect()] == ["http://a/", "http://b/"]


def test_equal_feature_names_keep_their_order(spark):
    line = "1\ta\ta\tX\tX\tb=2|B=1|a=0\t0\troot\t_\t_"
    assert spark.createDataFrame([(line,)], "l STRING").select(tx.sort_feats(F.col("l"))).first()[0].split("\t")[5] == "a=0|B=1|b=2"


def test_shared_folder_is_required_on_a_cluster():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_pages_with_odd_markup(spark):
    """Quoted attributes, raw text, and what is never closed."""
    cases = [
        ("<p title='a>b'>caf&eacute; &#8217;x", "café ’x"),
        ('<a href="x>y" title=it\'s>in</a> 3 < 4 <5> & 6>', "in 3 < 4 <5> & 6>"),
        ("a<script>if (a<b) x='</p>'</script>b<SCRIPT src='q>'>c</scripty></script >d", "a b d"),
        ("one<style>p{}</style><noscript><p>no</p></noscript>two<scripts>three</scripts>", "one two three"),
        ("x<script>never closed <p>y", "x"), ("x<!-- never closed <p>y", "x"), ("x<!--a-->y<!-->z<!--->w<!-- <b> --!>v", "x y z w v"),
        ("<!DOCTYPE html><?xml a='1'?></ bogus>t<div class=\"open", "t"), ("<p =x>a<p a = 'b>c' d=\"e>f\" g>h", "a h"),
        ("a&nbsp;&#160;&#xA0;b c", "a b c"), ("&lt;b&gt; &amp;lt; &amp;amp; &quot;q&quot; &apos;", "<b> &lt; &amp; \"q\" '"),
        ("&copy2024 &notit; &foo; &; & &#; &#x; &#0; &#x110000; &#xD800; &#128; &#129; &#99999999999; &#1; &#65 &#x1F600;&amp", "©2024 ¬it; &foo; &; & &#; &#x; � � � € \x81 � A 😀&"),
        ("", ""), (None, None), ("plain", "plain"), ("<" * 50, "<" * 50), ("<a " + "x=" * 3000 + ">t", "t"), ("<a " + "='" * 2999 + ">t", "t")]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, html string").select("i", tx.html_to_text(F.col("html")).alias("t"))
    got = {r["i"]: r["t"] for r in df.collect()}
    assert [(cases[i][0] and cases[i][0][:60], got[i]) for i in range(len(cases))] == [(h and h[:60], t) for h, t in cases]
    titles = [("<script>var t='<title>no</title>'</script><title lang=\"a>b\">caf&eacute;\n</title>", "café"), ("<!-- <title>x</title> -->", "Untitled"), ("<title>open", "open"),
              ("<titles>x</titles>", "Untitled"), ("<TITLE></TITLE>", ""), ("<title> a <b> </title><title>c</title>", "a <b>")]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(titles)], "i int, html string").select("i", tx.page_title(F.col("html")).alias("t"))
    assert [r["t"] for r in df.orderBy("i").collect()] == [t for _, t in titles]


def test_all_character_references(spark):
    """Against the standard library: every name, every number that it treats in a special way, and some others."""
    import html
    numbers = [*range(0, 170), 0x152, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000]
    refs = ["&" + n for n in html.entities.html5] + [f"&{n}x" for n in html.entities.html5 if not n.endswith(";")]
    refs += [f"&#{n};" for n in numbers] + [f"&#x{n:X};" for n in numbers] + [f"&#X{n:x}" for n in numbers]
    df = spark.createDataFrame([(i, f"a{r} b") for i, r in enumerate(refs)], "i int, t string").select("i", tx.decode_references(F.col("t")).alias("d"))
    got = {r["i"]: r["d"] for r in df.collect()}
    assert [(r, got[i]) for i, r in enumerate(refs) if got[i] != html.unescape(f"a{r} b")] == []
