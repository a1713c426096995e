"""Runs: stretches of words that repeat with a period, found in an enhanced suffix array of each document.

Two suffixes ``i`` and ``i + d`` whose longest common prefix is exactly ``d`` words are a branching tandem repeat: a square of root length ``d``
that cannot be moved one word to the right. Every run holds exactly one of them for its period, at its right end.

1. Suffixes are sorted by doubling; ranks are the inverse suffix array (ISA), and the ranks of the single rounds answer how far two suffixes agree.
   The words of each document carry its number, so that one array holds many documents and no interval crosses them.
2. Every position of the LCP array splits its LCP interval in two. For each suffix ``i`` of the smaller side, of depth ``d``, the other side is asked
   for ``i + d`` and ``i - d`` by its ISA range: n log n questions in all, and no tree is built.
3. Squares are rotated to the left while the word before them fits, which gives the whole run; one that is found with a multiple of its period has
   the same ends as the one with the period itself, and is merged with it.

A run of ``LEAST`` words and ``TIMES`` periods repeats ``DEPTH`` words of the document; documents without such a repeat are not sorted to the end.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import chunks

#: Least words and periods of a run, and the common prefix that two suffixes of a run have at least: min over q of max(24, 3 q) - q.
LEAST, TIMES, DEPTH = 24, 3, 16
#: Bytes of text whose suffixes are sorted together (a longer text stands alone), and questions that are asked at once.
TOGETHER, ASKED = 1 << 21, 1 << 21


def numbered(lists: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all lists, 0 after each of them, and the offset of each list."""
    number = defaultdict(count(1).__next__)
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in lists], out=offsets[1:])
    codes = np.zeros(offsets[-1], np.int64)
    at = np.ones(len(codes), bool)
    at[offsets[1:] - 1] = False
    codes[at] = np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), np.int64, len(codes) - len(lists))
    return codes, offsets


def ranks(codes: np.ndarray, offsets: np.ndarray, depth: int | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """(rank of each suffix by its first 1, 2, 4, ... words; suffixes that share their first ``depth`` words with another of the document).

    Without ``depth`` the rounds go on until all ranks differ; the last ones are the inverse suffix array.
    """
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rank, active = np.zeros(len(codes), np.int64), np.arange(len(codes))
    second, levels, reach = owner * (codes.max(initial=0) + 1) + codes, [], 0
    while len(active):
        old = rank[active]
        order = np.argsort(second, kind="stable") if not reach else np.lexsort((second, old))
        active, old, second = active[order], old[order], second[order]
        at = np.arange(len(active))
        outer = np.concatenate(([True], old[1:] != old[:-1]))
        first = outer | np.concatenate(([True], second[1:] != second[:-1]))
        new = old + np.maximum.accumulate(np.where(first, at, 0)) - np.maximum.accumulate(np.where(outer, at, 0))
        rank[active] = new
        active = np.sort(active[~(first & np.concatenate((first[1:], [True])))])
        reach = 2 * reach or 1
        if depth is None:
            levels.append(rank.astype(np.int32))
        elif reach >= depth:
            break
        second = rank[active + reach]
    return levels, active


def agreement(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of words in which the different suffixes ``a`` and ``b`` agree."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        out += (levels[k][a + out] == levels[k][b + out]).astype(np.int64) << k
    return out


def bounds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the last one before with a smaller value, and the first one behind with a value that is not larger."""
    values = lcp.tolist()
    before, behind, open_ = [0] * len(values), [len(values)] * len(values), []
    for p, value in enumerate(values):
        while open_ and values[open_[-1]] >= value:
            behind[open_.pop()] = p
        before[p] = open_[-1] if open_ else 0
        open_.append(p)
    return np.array(before), np.array(behind)


def squares(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of all branching tandem repeats."""
    isa = levels[-1]
    n = len(isa)
    sa = np.empty(n, np.int32)
    sa[isa] = np.arange(n, dtype=np.int32)
    lcp = np.zeros(n, np.int64)
    near = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    lcp[near] = agreement(levels, sa[near - 1].astype(np.int64), sa[near].astype(np.int64))
    low, high = (x[near] for x in bounds(lcp))
    on_left = near - low <= high - near
    first, size = np.where(on_left, low, near), np.where(on_left, near - low, high - near)
    other, other_end = np.where(on_left, near, low), np.where(on_left, high, near)
    depth = lcp[near]
    starts, roots = [], []
    cuts = np.searchsorted(np.cumsum(size), np.arange(ASKED, size.sum() + ASKED, ASKED)) if len(near) else []
    for a, b in zip([0, *cuts], [*cuts, len(near)]):
        s = size[a:b]
        of = np.repeat(np.arange(a, b), s)
        i = sa[first[of] + np.arange(len(of)) - np.repeat(np.cumsum(s) - s, s)].astype(np.int64)
        for j in (i + depth[of], i - depth[of]):
            fits = np.flatnonzero((j >= 0) & (j < n))
            at = isa[j[fits]]
            hit = fits[(at >= other[of[fits]]) & (at < other_end[of[fits]])]
            starts.append(np.minimum(i[hit], j[hit]))
            roots.append(depth[of[hit]])
    return (np.concatenate(starts), np.concatenate(roots)) if starts else (np.zeros(0, np.int64),) * 2


def runs(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of every run, by start and period."""
    levels, _ = ranks(codes, offsets)
    start, period = squares(levels)
    left = np.zeros(len(start), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at = start - left - (1 << k)
        ok = np.flatnonzero(at >= 0)
        left[ok[levels[k][at[ok]] == levels[k][at[ok] + period[ok]]]] += 1 << k
    length = 2 * period + left
    keep = length >= np.maximum(least, times * period)
    begin, length, period = (start - left)[keep], length[keep], period[keep]
    by = np.lexsort((period, length, begin))
    begin, length, period = begin[by], length[by], period[by]
    first = np.concatenate(([True], (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])))[:len(begin)]
    begin, length, period = begin[first], length[first], period[first]
    by = np.lexsort((period, begin))
    doc = np.searchsorted(offsets, begin, "right") - 1
    return [(int(doc[k]), int(begin[k] - offsets[doc[k]]), int(length[k]), int(period[k])) for k in by]


def found_runs(lists: list[list], least: int = LEAST, times: int = TIMES, depth: int = DEPTH) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words."""
    codes, offsets = numbered(lists)
    _, often = ranks(codes, offsets, depth)
    some = np.unique(np.searchsorted(offsets, often, "right") - 1)
    out: list[list] = [[] for _ in lists]
    if len(some):
        inner = np.concatenate([codes[offsets[k]:offsets[k + 1]] for k in some])
        sizes = np.diff(offsets)[some]
        for doc, *run in runs(inner, np.concatenate(([0], np.cumsum(sizes))), least, times):
            out[some[doc]].append(tuple(run))
    return out


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that stay when every run keeps its first period only."""
    if not found:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in found:
        gone[start + period:start + length] = True
    return [words[k] for k in np.flatnonzero(~gone)]


def strongest(found: list[tuple[int, int, int]]) -> tuple:
    """(start, length, period, exponent_milli) of the run with most periods; ties to the smallest start, then period."""
    best = None
    for start, length, period in found:
        if best is None or length * best[2] > best[1] * period:
            best = start, length, period
    return (*best, 1000 * best[1] // best[2]) if best else (None,) * 4


def planted(doc_id: int | None, words: list) -> list:
    """The words with a period put into them for one id in ten, as the query's contract states; a null id has none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


SCHEMA = ("doc_id LONG, n_runs LONG, start LONG, length LONG, period LONG, exponent_milli LONG, runs_sha256 STRING, collapsed_sha256 STRING")
TYPES = pa.schema([(c.split()[0], pa.int64() if c.endswith("LONG") else pa.string()) for c in SCHEMA.split(", ")])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", change=None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_runs, the strongest run (start, length, period, exponent_milli) and digests of all runs and of the
    words that stay.

    Words are runs of other characters than blank and TAB to CR. ``change`` (doc_id, words) may rewrite a document's words first. Null and empty texts
    have no words and no run; a null id is carried through; repeated rows come back each; an empty table gives none; extra columns are not read. A document is sorted in
    one task, in about 150 bytes of memory for each of its words.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in chunks(texts, TOGETHER):
                lists = [(t or b"").split() for t in texts[part]]
                if change:
                    lists = [change(i, ws) for i, ws in zip(ids[part], lists)]
                out = []
                for i, ws, found in zip(ids[part], lists, found_runs(lists)):
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
                    kept = b" ".join(collapsed(ws, found))
                    out.append((i, len(found), *strongest(found), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), TYPES)], schema=TYPES)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(each, SCHEMA)
