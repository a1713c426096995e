import zlib
from collections import Counter, defaultdict

import pytest

from textloom.llm import queries, sharding
from tests.conftest import SF


def brute(pairs, shards):
    """Key order, running bytes, middle byte."""
    order = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, zlib.crc32((p[1] or "").encode())))
    sizes = [len((t or "").encode()) + 16 for _, t in order]
    total, done, out, slots = sum(sizes), 0, [], Counter()
    for (i, t), size in zip(order, sizes):
        s = (2 * done + size) * shards // (2 * total)
        out.append((i, size, zlib.crc32((t or "").encode()), "bytes", s, slots[s], None))
        slots[s] += 1
        done += size
    return Counter(out)


COLS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def run(df):
    return Counter(tuple(r[c] for c in COLS) for r in df.collect())


@pytest.mark.parametrize("pairs", [
    [(i, "é" * (i % 37)) for i in range(500)],
    [(None, None), (3, ""), (3, ""), (2, "x" * 5000), (1, "a"), (None, "b")],
    [(7, f"text {i % 5}") for i in range(400)] + [(i, "y") for i in range(100)],
    [],
])
def test_same_as_brute_force(rows, pairs):
    got = sharding.shard_by_bytes(rows(pairs), 7)
    assert run(got) == brute(pairs, 7)


def test_overfull_ranges_are_cut(rows, monkeypatch):
    """A bad sample (no cut at all) must not change the result."""
    monkeypatch.setattr(sharding, "splitters", lambda slim, ranges, total, seed=7: [(10, 0), (11, 0)])
    pairs = [(i, "z" * (i % 11)) for i in range(3000)]
    assert run(sharding.shard_by_bytes(rows(pairs), 5)) == brute(pairs, 5)


def test_query(spark):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op1_sampled_splitters(spark, SF)
    assert run(got) == brute(pairs, 40)
    size, slots = defaultdict(int), defaultdict(list)
    for r in got.collect():
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    largest = max(len((t or "").encode()) + 16 for _, t in pairs)
    assert all(abs(b - sum(size.values()) / 40) < largest for b in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
