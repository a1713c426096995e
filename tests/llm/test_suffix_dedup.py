import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from textloom.llm import induced_sort, queries, suffix_dedup
from textloom.llm.common import numbered
from tests.conftest import SF


def brute(pairs, n=100):
    """Every string of every text, in order."""
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][0] is None, pairs[k][0] or 0, k))
    seen, out = set(), []
    for k in order:
        i, data = pairs[k][0], (pairs[k][1] or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - n + 1):
            w = data[s:s + n]
            if w in seen:
                gone[s:s + n] = True
            seen.add(w)
        gone = gone[:len(data)]
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


COLS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def run(df):
    return Counter(tuple(r[c] for c in COLS) for r in df.collect())


@pytest.mark.parametrize("memory", [1 << 20, 0])
def test_suffix_order(memory):
    """Against sorting; with no memory every queue entry goes through the scratch file."""
    rng = np.random.default_rng(1)
    texts = [b"", b"a", b"aaaaaaaaab", b"banana" * 30, b"ab" * 200, bytes(rng.integers(0, 256, 700, dtype=np.uint8)),
             bytes(rng.integers(97, 99, 900, dtype=np.uint8)), b"mississippi", b"zyxw" * 9, b"abcd" * 9, b"\0\0\1\0" * 20]
    for x in texts:
        t = np.append(np.frombuffer(x, np.uint8).astype(np.int16) + 1, 0)
        got = induced_sort.suffix_order(t, len(t) + 1, memory)
        assert got.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist()), x[:20]


def test_queues_give_what_waits_at_once():
    """In arrival order, within the memory, and also what comes while the queue is read; the rounds of a sort grow with its bytes, not with its text."""
    for memory, want in ((1 << 20, [[1, 2, 3, 4], [5]]), (0, [[1], [2, 3], [4], [5]])):
        queues, got = induced_sort.Queues(2, memory), []
        for part in ([1], [2, 3], [4]):
            queues.put(1, np.array(part, np.int32))
        for positions in queues.take(1):
            got.append(positions.tolist())
            if 4 in got[-1]:
                queues.put(1, np.array([5], np.int32))
        assert got == want and queues.held == 0


def test_rounds_of_a_sort(monkeypatch):
    """A shard's piece is sorted in few rounds, however many small arrays its queues were filled with."""
    rounds, plain = [], induced_sort.Queues.hand_on
    monkeypatch.setattr(induced_sort.Queues, "hand_on", lambda self, *a: (rounds.append(1), plain(self, *a))[1])
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, k, dtype=np.uint8)) for k in rng.integers(2, 9, 500)]
    text = b" ".join(words[k] for k in rng.integers(0, 500, 20000))
    t = np.append(np.frombuffer(text, np.uint8).astype(np.int16) + 1, 0)
    order = induced_sort.suffix_order(t, 100)
    assert sorted(order.tolist()) == list(range(len(t))) and len(rounds) < 2000
    few = order[::500].tolist()
    assert all((text[a:a + 99] + b"\0") <= (text[b:b + 99] + b"\xff") for a, b in zip(few, few[1:]))


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefgh é😀"
    text = lambda k: "".join(rng.choices(letters, k=k))
    passages = [text(k) for k in (90, 100, 101, 130, 150, 260)]
    out = []
    for i in range(120):
        body = text(rng.choice([0, 30, 99, 150, 400]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(body))
            p = rng.choice(passages)
            body = body[:at] + p[rng.choice([0, 0, 5]):] + body[at:]
        out.append((200 - i, body))
    out += [(500 + i, out[7 * i][1]) for i in range(10)] + [(501, text(140)), (None, passages[3]), (None, passages[5]), (3, None), (4, ""), (4, "x")]
    out += [(700, "a" * 1000), (701, "ab" * 300), (702, "a" * 500), (703, ("line of some words, " * 12 + "\n") * 9)]
    return out


@pytest.mark.parametrize("seed,hot,held", [(1, 1000, 8 << 20), (2, 2, 8 << 20), (3, 1000, 500)])
def test_same_as_brute_force(rows, monkeypatch, seed, hot, held):
    """Also with hot anchors dealt by string, and with little held back in a task."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HELD_BYTES", held)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 3000)
    pairs = corpus(seed)
    want = brute(pairs)
    assert run(suffix_dedup.deduplicated(rows(pairs).coalesce(1))) == want == run(suffix_dedup.deduplicated(rows(pairs)))
    assert sum(n for _, _, n, _, _ in want) > 3000


def test_row_numbers_do_not_depend_on_splits(rows, spark, tmp_path):
    """One number for each row, the same in every scan, also beside columns with the names that are used on the way."""
    df = rows(corpus(5)).withColumnRenamed("key", "file_path").withColumnRenamed("size", "rid")
    df.repartition(9).write.parquet(str(tmp_path / "docs"))
    seen = []
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = numbered(spark.read.parquet(str(tmp_path / "docs")), "_rid").select("_rid", "doc_id", "text").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len({r["_rid"] for r in got}) == len(got) == df.count()
        seen.append({r["_rid"]: (r["doc_id"], r["text"]) for r in got})
    assert seen[0] == seen[1]
    other = numbered(df, "_rid")  # no files: written once
    assert sorted(map(str, other.select("_rid").collect())) == sorted(map(str, other.select("_rid").collect())) and other.columns == [*df.columns, "_rid"]


def test_empty(rows):
    assert run(suffix_dedup.deduplicated(rows([]))) == Counter()
    assert run(suffix_dedup.deduplicated(rows([(1, None), (2, "short")]))) == brute([(1, None), (2, "short")])


def test_query(spark):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert run(queries.op7_external_induced_sorting(spark, SF)) == brute(pairs)
