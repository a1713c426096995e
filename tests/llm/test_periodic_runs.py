import hashlib
import random
import zlib
from collections import Counter

import pytest

from textloom.llm import periodic_runs, queries
from tests.conftest import SF

COLS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def all_runs(w, least=24, times=3):
    """Every maximal stretch for every period; a stretch counts with its smallest one."""
    seen = {}
    for p in range(1, len(w) // times + 1):
        a = 0
        for i in range(p, len(w) + 1):
            if i == len(w) or w[i] != w[i - p]:
                if i - a >= max(least, times * p):
                    seen.setdefault((a, i - a), p)
                a = i - p + 1
    return sorted(((s, n, p) for (s, n), p in seen.items()), key=lambda r: (r[0], r[2]))


def brute(i, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = all_runs(w)
    best = sorted(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))[0] if found else None
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join("%d,%d,%d\n" % r for r in found).encode()), sha(kept))


def run(df):
    return Counter(tuple(r[c] for c in COLS) for r in df.collect())


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    lists = []
    for _ in range(60):
        w = []
        while len(w) < rng.choice([0, 1, 5, 60, 200]):
            root = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 9, 30]))]
            w += (root * rng.choice([1, 1, 2, 3, 7, 30]))[:rng.choice([10, 100])]
        lists.append(w)
    for least, times, depth in ((24, 3, 16), (2, 2, 1)):
        assert periodic_runs.found_runs(lists, least, times, depth) == [all_runs(w, least, times) for w in lists]


def test_squares_asked_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic_runs, "ASKED", 7)
    w = list("abcabcabcabcabcabcabcabcabcabx" + "y" * 40 + "ab" * 20)
    assert periodic_runs.found_runs([w, w[3:]]) == [all_runs(w), all_runs(w[3:])]


def test_odd_rows(rows):
    long = " ".join(f"w{k % 7000}" for k in range(30_000))
    pairs = [(1, None), (2, ""), (3, " \t\n "), (None, "a " * 30), (None, None), (4, "x " * 24), (5, "x " * 23), (5, "é ü " * 12), (5, "é ü " * 12),
             (10, "q r " * 50), (11, long), (12, "a b c " * 7 + "d " + "a b c " * 8)]
    got = run(periodic_runs.periodic_runs(rows(pairs), change=periodic_runs.planted))
    short = [p for p in pairs if p[0] != 11]
    want = Counter(brute(*p) for p in short)
    assert {r for r in got if r[0] != 11} == set(want) and sum(got.values()) == len(pairs)
    assert [r[:6] for r in got if r[0] == 11] == [(11, 1, 0, 30_000, 7000, 4285)] or zlib.crc32(b"11") % 10 == 0
    assert not periodic_runs.periodic_runs(rows([])).collect()


def test_query(spark):
    """On all documents; those of more than 1,500 words by a comparison for each period that numpy can do."""
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: r for r in run(queries.op12_periodic_runs(spark, SF))}
    assert len(got) == len(pairs)
    some = [p for p in pairs if len(p[1].split()) <= 1500]
    assert len(some) > len(pairs) // 2
    for p in some:
        assert got[p[0]] == brute(*p)
