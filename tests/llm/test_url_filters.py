import random
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from textloom.llm import url_filters as uf
from tests.llm.sql import same_as_sql


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            best = max(best or (0, "", ""), (len(rule), rule, verdict))
    return host, path, best and best[1], best[2] if best else default


URLS = [None, "", "no scheme", "http://", "http://NET/", "http://net", "https://a.example.NET/en/x?y#z", "http://xexample.net/en/",
        "http://example.com/de", "http://example.com/de/", "http://org/fr/a://b/", "http://a.b.org/fr/q?u=http://x.net/", "x://a.net?q/en/",
        "http://example.net/en/../", "http://a..net/", "http://a.net/\nfr/", "http://.net/", "http://ÄÖ.example.net/EN/", "://q.org/fr/"]


def test_hand_picked(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS)], "page_id LONG, url STRING, host STRING, token STRING")
    got = {r.page_id: tuple(r)[1:] for r in uf.judge_urls(pages, uf.rule_table(spark, uf.RULES)).collect()}
    assert got == {i: brute(u, uf.RULES) for i, u in enumerate(URLS + URLS)}


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_many_rules(spark, monkeypatch, bound):
    """Also without a broadcast of the rules."""
    monkeypatch.setattr(uf, "INDEX_BYTES", bound)
    rng = random.Random(4)
    names = ["a", "b", "cc", "net", "org", "x-y", "a+b", "(", "é"]
    make = lambda: (".".join(rng.choices(names, k=rng.randint(1, 3))), "".join(f"/{p}" for p in rng.choices(names, k=rng.randint(0, 3))))
    rules = list({h + p: (rng.choice(["allow", "block"]), h + p) for h, p in (make() for _ in range(150))}.values())
    urls = ["http://%s%s%s" % (*make(), rng.choice(["", "/", "?q", "#f", "/tail"])) for _ in range(800)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id LONG, url STRING")
    got = {r.page_id: tuple(r)[1:] for r in uf.judge_urls(pages, uf.rule_table(spark, rules), "block").collect()}
    assert got == {i: brute(u, rules, "block") for i, u in enumerate(urls)}
    assert sum(v[2] is not None for v in got.values()) > 50


def test_empty_tables(spark):
    rules, none = uf.rule_table(spark, uf.RULES), uf.rule_table(spark, [])
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id LONG, url STRING")
    assert uf.judge_urls(pages.limit(0), rules).count() == 0
    assert uf.judge_urls(pages, none).select("rule", "verdict").first() == (None, "allow")


def test_query(spark):
    same_as_sql(spark, "op4_url_filters")


def test_host_agrees_with_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in pages.select("url", uf.host_of(F.col("url")).alias("h"), uf.path_of(F.col("url")).alias("p")).collect():
        assert (r.h, r.p) == (urlsplit(r.url).netloc, urlsplit(r.url).path)
