import base64
import glob
import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import queries, warc
from tests.conftest import SF

SCHEMA = "page_id LONG, url STRING, html STRING, surt STRING, sha STRING, first INT, id STRING, file STRING"


def brute(pages, least=0):
    first = {}
    for i, _, h in pages:
        h = h or ""
        if i is not None:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        f = first.get(h or "")
        again = len(data) >= least and f is not None and f != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None))
    return Counter(out)


PAGES = [(5, "http://b.example.org/x", "<p>é</p>"), (2, "http://a.example.org/x", "<p>é</p>"), (9, None, None), (4, "nothing", ""),
         (None, "http://a.b/", "only null"), (None, "http://a.b/", "<p>é</p>"), (7, "http://a.b/\r\nX: y", "\r\n\r\nodd\r\n\r\n"),
         (2, "http://a.example.org/x", "<p>é</p>"), (3, "http://A.b:80/?q", "x" * 300_000), (8, "://", "WARC/1.1\r\n")]


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*p, "a", "b", 1, "c", "d") for p in PAGES], SCHEMA)
    assert Counter(map(tuple, warc.archived(pages, least).collect())) == brute(PAGES, least)
    assert warc.archived(pages.limit(0)).count() == 0


def test_blocks_and_ranges(spark, tmp_path, monkeypatch):
    """Small blocks, equal keys over several blocks, payloads restored, archives readable by any gzip reader."""
    pages = [(i % 70, f"http://h{i % 7}.example.net/{i % 70}", f"page {i % 90}") for i in range(400)]
    df = spark.createDataFrame(pages, "page_id LONG, url STRING, html STRING").repartition(5)
    captures = warc.write_archives(df, str(tmp_path / "a"))
    files = warc.build_index(captures, str(tmp_path / "i"), block_lines=3)
    assert [f[:2] for f in files] == sorted(f[:2] for f in files)
    got = warc.lookup(df.filter("page_id = 11"), files).collect()
    want = [p for p in pages if p[0] == 11]
    assert len(got) == len(want) == 6 - (11 >= 50)
    texts = {r.payload for r in got if r.record_type == "response"}
    assert texts <= {p[2] for p in want}
    assert warc.lookup(df.filter("page_id = 11").withColumn("url", F.lit("http://nowhere/")), files).count() == 0
    whole = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "a/*.warc.gz")))
    assert whole.count(b"WARC/1.1\r\n") == 400


def test_keys_in_order(spark):
    df = spark.createDataFrame([("http://www.Example.org/a?b#c",), ("x",), (None,)], "u STRING").select(warc.surt_key(F.col("u")))
    assert [r[0] for r in df.collect()] == ["org,example,www)/a?b#c", ")x", ")"]


def test_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert Counter(map(tuple, queries.op3_two_level_capture_index(spark, SF).collect())) == brute(pages)
