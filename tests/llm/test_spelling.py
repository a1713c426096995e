import random
import re
import zlib
from collections import Counter

import pytest

from textloom.llm import queries, spelling
from tests.conftest import SF

COLS = "word form root n n_near form_n".split()


def brute(pairs):
    """All words at distance 1 by trying every deletion, and every pair with equal deletions."""
    n = Counter()
    for i, t in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    holes, near = {}, {w: set() for w in n}
    for w in n:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1:]), set()).add(w)
            v = w[:k] + w[k + 1:]
            if v in n:
                near[w].add(v)
                near[v].add(w)
    for some in holes.values():
        for w in some:
            near[w] |= some - {w}
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top and n[top] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def run(df):
    got = [tuple(r[c] for c in COLS) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcé", k=rng.randint(4, 8))) for _ in range(60)]
    out = []
    for i in range(400):
        some = []
        for _ in range(rng.choice([0, 1, 20, 60])):
            w = rng.choice(stems[:rng.choice([3, 60])])
            if rng.random() < 0.3:
                k = rng.randrange(len(w) + 1)
                w = w[:k] + rng.choice(["", "a", "b", "Ab", "×"]) + w[k + rng.choice([0, 1]):]
            some.append(w)
        out.append((i, rng.choice([" ", ", ", "1", "\n"]).join(some)))
    return out


@pytest.mark.parametrize("seed,ranges,held", [(1, 50_000, 200_000), (2, 40, 30), (3, 7, 5)])
def test_same_as_brute_force(rows, monkeypatch, seed, ranges, held):
    """Also with many ranges, whose cuts share prefixes with words on both sides."""
    monkeypatch.setattr(spelling, "RANGE", ranges)
    monkeypatch.setattr(spelling, "HELD", held)
    pairs = corpus(seed)
    want = brute(pairs)
    assert any(f != r for _, f, r, *_ in want if f) and len(want) > 100
    assert run(spelling.spelling_variants(rows(pairs), change=spelling.planted)) == want


def test_numbers_name_nodes(rows, spark, monkeypatch):
    """One number for each prefix, one prefix for each number."""
    monkeypatch.setattr(spelling, "RANGE", 9)
    words = sorted({w for _, t in corpus(5) for w in re.findall("[a-zé]{5,}", t)})
    df = spark.createDataFrame([(w, 3) for w in words], "word STRING, n LONG")
    got = spelling.node_pairs(df).collect()
    for column, turn in (("before", 1), ("behind", -1)):
        pairs = {(w[::turn][:k], r[column][k]) for r in got for w in [r.word] for k in range(len(w) + 1)}
        assert len(pairs) == len({p for p, _ in pairs}) == len({x for _, x in pairs})
    assert [r.word for r in sorted(got, key=lambda r: r.id)] == words


def test_odd_rows(rows):
    for pairs in ([], [(1, None), (2, ""), (None, "123 -")], [(None, "Aaaaa aaaaa aaaaA aaaaaa aaaaaa aaaaaa b"), (None, "aaaaa"), (1, "aaaaa"), (1, "aaaaa")]):
        assert run(spelling.spelling_variants(rows(pairs), change=spelling.planted)) == brute(pairs)
    long = "ab" * 20_000
    pairs = [(k, f"{long} {long}x {long[1:]}") for k in (1, 1, 1, 2)]
    want = {(long, None, long, 4, 2, None), (long + "x", None, long + "x", 4, 1, None), (long[1:], None, long[1:], 4, 1, None)}
    assert run(spelling.spelling_variants(rows(pairs))) == want


def test_query(spark):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert run(queries.op13_trie_node_pairs(spark, SF)) == brute(pairs)
