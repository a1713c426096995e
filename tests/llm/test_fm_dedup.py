import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from textloom.llm import fm_dedup, queries
from textloom.llm.fm_index import FMIndex
from tests.conftest import SF

COLS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def brute(pairs, n=13):
    """Every window of every text."""
    least = {}
    order = lambda i: (1 << 63) - 1 if i is None else i
    for i, t in pairs:
        w = (t or "").encode().split()
        for s in range(len(w) - n + 1):
            k = tuple(w[s:s + n])
            least[k] = min(least.get(k, order(i)), order(i))
    out = []
    for i, t in pairs:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - n + 1):
            if least[tuple(w[s:s + n])] < order(i):
                gone[s:s + n] = True
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return Counter(out)


def run(df):
    return Counter(tuple(r[c] for c in COLS) for r in df.collect())


@pytest.mark.parametrize("seed", range(8))
def test_index(seed):
    """Windows of streams that the index holds in part, with the smallest value among their places."""
    rng, rr = np.random.default_rng(seed), random.Random(seed)
    top, n = rr.choice([1, 2, 3, 50]), rr.choice([2, 3, 5, 13])
    some = [rng.integers(1, top + 1, rr.randint(n, n + 12)) for _ in range(rr.choice([1, 5, 60]))]
    some += [some[rr.randrange(len(some))] for _ in range(5)]
    values = [rr.randint(0, 9) for _ in some]
    index = FMIndex(np.concatenate([np.append(s, 0) for s in some]), np.repeat(values, [len(s) + 1 for s in some]), n, top + 1)
    stream = some + [rng.integers(1, top + 1, rr.randint(1, n + 12)) for _ in range(20)]
    size = np.array([len(s) for s in stream])
    got = sorted(zip(*(x.tolist() for x in index.matches(np.concatenate(stream), np.cumsum(size), size))))
    least = {}
    for s, v in zip(some, values):
        for i in range(len(s) - n + 1):
            least[tuple(s[i:i + n])] = min(least.get(tuple(s[i:i + n]), v), v)
    want = [(k, i, least[tuple(s[i:i + n])]) for k, s in enumerate(stream) for i in range(len(s) - n + 1) if tuple(s[i:i + n]) in least]
    assert got == sorted(want)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyzé😀"]
    text = lambda k: rng.choices(words, k=k)
    passages = [text(k) for k in (12, 13, 14, 20, 60, 150)]
    out = []
    for i in range(150):
        body = text(rng.choice([0, 5, 13, 60, 200]))
        for _ in range(rng.choice([0, 1, 2])):
            p, at = rng.choice(passages), rng.randint(0, len(body))
            body = body[:at] + p[rng.choice([0, 0, 5]):] + body[at:]
        out.append((300 - i, rng.choice([" ", "\n", " \t "]).join(body)))
    out += [(500 + i, out[7 * i][1]) for i in range(20)] + [(501, out[3][1]), (None, out[4][1]), (None, out[4][1]), (3, None), (4, ""), (4, " \n ")]
    out += [(700, "data " * 900), (701, "data " * 40), (702, "a b " * 100), (703, "data " * 5)]
    return out


@pytest.mark.parametrize("seed,frequent,index,together", [(1, 4096, 1 << 19, 1 << 21), (2, 50, 300, 1 << 21), (3, 4096, 1, 500)])
def test_same_as_brute_force(rows, monkeypatch, seed, frequent, index, together):
    """Also with many small indexes, and with texts cut into overlapping pieces."""
    monkeypatch.setattr(fm_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(fm_dedup, "INDEX_WORDS", index)
    monkeypatch.setattr(fm_dedup, "TOGETHER", together)
    pairs = corpus(seed)
    want = brute(pairs)
    assert sum(r[2] * n for r, n in want.items()) > 3000
    assert run(fm_dedup.without_repeated_words(rows(pairs).coalesce(1))) == want == run(fm_dedup.without_repeated_words(rows(pairs)))


def test_equal_hashes_are_told_apart(rows, monkeypatch):
    """With one hash for everything the bytes still decide."""
    monkeypatch.setattr(fm_dedup, "span_hash", lambda sums, a, b: np.zeros(len(a), np.uint64))
    pairs = corpus(4)[:60]
    assert run(fm_dedup.without_repeated_words(rows(pairs).coalesce(2))) == brute(pairs)


def test_odd_rows(rows):
    assert run(fm_dedup.without_repeated_words(rows([]))) == Counter()
    few = [(1, None), (2, "one two"), (2, "one two"), (None, None)]
    assert run(fm_dedup.without_repeated_words(rows(few))) == brute(few)
    long = " ".join(f"w{k % 9000}" for k in range(400_000))
    pairs = [(1, " ".join(f"w{k}" for k in range(100, 8000))), (2, long), (3, long)]
    assert run(fm_dedup.without_repeated_words(rows(pairs))) == brute(pairs)


def test_query(spark):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert run(queries.op11_fm_index(spark, SF)) == brute(pairs)
