"""Removal of repeated byte strings, decided by suffix arrays of shards.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts earlier (smaller id, or the same document further left).

1. Every string of ``LENGTH`` bytes has an anchor: its ``ANCHOR``-byte piece with the smallest hash. Equal strings have equal anchors, so a
   string can only repeat if its anchor does. Neighbouring strings mostly share an anchor and travel as one segment.
2. Anchors are counted over all documents. Those that occur once are done; the rest is marked in a bitmap of fixed size.
3. Segments with a marked anchor go to the shard of the anchor; equal segments of a task are sent once, the later ones are repeats already.
   Anchors with very many occurrences are dealt by the string itself, so no shard gathers them.
4. A shard sorts the suffixes of its segments by induced sorting, a bounded piece at a time, and neighbours with a common prefix of ``LENGTH``
   are equal strings: all but the earliest are repeats.
5. The covered ranges are joined to the documents and cut out.

The bitmap only keeps work away; which strings are equal is decided by comparing their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import chunks, free_name, joined, mix64, numbered, prefix_hash, span_hash, stored
from textloom.llm.induced_sort import equal_neighbours, suffix_order
from textloom.llm.ngram_join import bit_table, by_part, dealt, marked, part_count

LENGTH, ANCHOR = 100, 32
#: Bits of the bitmap of repeated anchors, and of the one of hot anchors with this many occurrences or more.
BITS, HOT_BITS, HOT = 27, 22, 1000
#: Bytes of segments that are sorted at once, and held for de-duplication in a scanning task.
SORT_BYTES, HELD_BYTES = 2 << 20, 8 << 20

SEGMENT = "h LONG, id LONG, rid LONG, start LONG, seg BINARY, strings LONG"
MARK = "rid LONG, a LONG, b LONG"


def segments(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Runs of strings with the same anchor: bytes of all texts, text number, first string start and last (in the text), offset, anchor hash."""
    data, offsets = joined(texts)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return data, none, none, none, none, np.zeros(0, np.uint64)
    sums = prefix_hash(data)
    at = np.arange(len(data) - ANCHOR + 1)
    h = span_hash(sums, at, at + ANCHOR)
    low = np.uint64((1 << 31) - 1)
    least = (h & ~low) | at.astype(np.uint64)
    width, want = 1, LENGTH - ANCHOR + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[:len(least) - (want - width)], least[want - width:])
    anchor = (least & low).astype(np.int64)  # of the string at each position
    valid = np.zeros(len(anchor) + 1, bool)
    for a, b in zip(offsets, offsets[1:] - 1):
        valid[a:max(a, b - LENGTH + 1)] = True
    valid = valid[:len(anchor)]
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(begin)
    stop = ~valid
    stop[:-1] |= begin[1:]
    stop[-1] = True
    last = np.flatnonzero(stop & valid | (valid & np.append(~valid[1:], True)))
    owner = np.searchsorted(offsets, first, "right") - 1
    return data, owner, first, last, offsets[owner], h[anchor[first]]


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(h, c): the anchors that occur at least twice in (text), and how often."""
    parts = part_count(rows.sparkSession)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for batch in batches:
            texts = batch["text"].tolist()
            for part in chunks(texts):
                held.append(segments(texts[part])[-1])
                if sum(map(len, held)) > 1 << 19:
                    yield pd.DataFrame(list(dealt(np.concatenate(held), parts)), columns=["part", "h"])
                    held = []
        if sum(map(len, held)):
            yield pd.DataFrame(list(dealt(np.concatenate(held), parts)), columns=["part", "h"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, (h,) in by_part(batches, ["h"]):
            h = np.sort(h)
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            c = np.diff(np.append(first, len(h)))
            yield pd.DataFrame({"h": h[first[c > 1]].astype(np.int64), "c": c[c > 1]})

    blocks = rows.select("text").mapInPandas(emit, "part INT, h BINARY").repartition("part").sortWithinPartitions("part")
    return stored(blocks.mapInPandas(count, "h LONG, c LONG"), "anchors")


def candidates(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Two kinds of rows: segments to be sorted, and (``seg`` null) ranges from start to ``strings`` that are repeats already."""
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast((bit_table(anchors, "h", BITS), bit_table(anchors.filter(F.col("c") >= HOT), "h", HOT_BITS)))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, hot = known.value
        seen: dict[bytes, tuple] = {}
        size = 0

        names = ["h", "id", "rid", "start", "seg", "strings"]

        def flush() -> pd.DataFrame:
            found = [(h, i, r, s, seg, 0) for seg, (i, r, s, h) in seen.items()]
            seen.clear()
            return pd.DataFrame(found, columns=names)

        def settled(done: list) -> pd.DataFrame:
            """Ranges of strings that are repeats already; neighbours become one row."""
            rid, start, count = (np.array(c, np.int64) for c in zip(*done))
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found = ranges(np.repeat(rid, count), np.repeat(start, count) + step)
            return pd.DataFrame({"h": found["rid"], "id": 0, "rid": found["rid"], "start": found["a"], "seg": pd.Series([None] * len(found), dtype=object),
                                 "strings": found["b"]})

        for batch in batches:
            texts, ids, rids = batch["text"].tolist(), batch["id"].to_numpy(), batch["rid"].to_numpy()
            for part in chunks(texts):
                data, owner, first, last, offset, h = segments(texts[part])
                some_ids, some_rids, done = ids[part], rids[part], []
                keep = np.flatnonzero(marked(often, h))
                is_hot = marked(hot, h[keep])
                blob = data.tobytes()
                for k, by_string in zip(keep, is_hot):
                    i, r = int(some_ids[owner[k]]), int(some_rids[owner[k]])
                    pieces = range(first[k], last[k] + 1) if by_string else (first[k],)
                    for a in pieces:
                        b = (a if by_string else last[k]) + LENGTH
                        seg, here = blob[a:b], (i, r, int(a - offset[k]))
                        other = seen.get(seg)
                        if other is None:
                            key = int(h[k].astype(np.int64))
                            if by_string:
                                key = int.from_bytes(hashlib.blake2b(seg, digest_size=8).digest(), "big", signed=True)
                            seen[seg] = (*here, key)
                            size += len(seg) + 200
                            continue
                        late = here if other[:3] < here else other[:3]
                        if late is not here:
                            seen[seg] = (*here, other[3])
                        done.append((late[1], late[2], b - a - LENGTH + 1))
                if done:
                    yield settled(done)
                if size > HELD_BYTES:
                    yield flush()
                    size = 0
        yield flush()

    return rows.select("id", "rid", "text").mapInPandas(emit, SEGMENT)


def sorted_repeats(found: list[tuple]) -> pd.DataFrame:
    """Ranges of repeats among whole groups of segments (id, rid, start, seg), by one suffix array."""
    sizes = np.array([len(f[3]) for f in found])
    data = np.frombuffer(b"".join(f[3] + b"\0" for f in found) + b"\0" * 8, np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    t = data[:len(data) - 7].astype(np.int16) + 2
    t[begin + sizes] = 1  # between segments
    t[-1] = 0
    owner = np.repeat(np.arange(len(found)), sizes - LENGTH + 1)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes - LENGTH + 1) - (sizes - LENGTH + 1), sizes - LENGTH + 1)
    string = np.full(len(t), -1, np.int64)
    string[begin[owner] + inner] = np.arange(len(owner))
    order = suffix_order(t, LENGTH)
    order = order[string[order] >= 0].astype(np.int64)
    same = equal_neighbours(data, order, LENGTH)
    group = np.cumsum(~same)
    at = string[order]
    ids, rids, starts = (np.array([f[k] for f in found], np.int64) for k in range(3))
    start = starts[owner[at]] + inner[at]
    by = np.lexsort((start, rids[owner[at]], ids[owner[at]], group))
    later = np.concatenate(([False], group[by][1:] == group[by][:-1]))[:len(by)]
    pick = by[later]
    return ranges(rids[owner[at[pick]]], start[pick])


def ranges(rid: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Neighbouring string starts of a document as covered byte ranges [a, b)."""
    order = np.lexsort((start, rid))
    rid, start = rid[order], start[order]
    cut = np.concatenate(([True], (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + 1)))[:len(rid)]
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(rid)) - 1
    return pd.DataFrame({"rid": rid[first], "a": start[first], "b": start[last[:len(first)]] + LENGTH})


def sort_shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by anchor. Equal segments of an anchor are settled by their bytes, the earliest stays; what differs in the group is sorted,
    pieces of about ``SORT_BYTES`` at once.

    A segment alone needs no sorting: two equal strings in it would have their anchor at two places, but it has one.
    """
    piece, size, group, now, late = [], 0, {}, None, []
    for batch in batches:
        for h, i, r, s, seg, end in zip(batch["h"], batch["id"], batch["rid"], batch["start"], batch["seg"], batch["strings"]):
            if seg is None:
                late.append((r, s, end))
                continue
            if h != now:
                if len(group) > 1:
                    piece.extend((*here, g) for g, here in group.items())
                    size += sum(map(len, group))
                now, group = h, {}
                if size > SORT_BYTES:
                    yield sorted_repeats(piece)
                    piece, size = [], 0
            here, other = (i, r, s), group.get(seg)
            if other is None:
                group[seg] = here
            else:
                group[seg] = min(here, other)
                _, rid, start = max(here, other)
                late.append((rid, start, start + len(seg)))
        if late:
            yield pd.DataFrame(late, columns=["rid", "a", "b"])
            late = []
    if len(group) > 1:
        piece.extend((*here, g) for g, here in group.items())
    if piece:
        yield sorted_repeats(piece)


def cut(text: str | None, a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, str]:
    """(bytes, removed bytes, removed runs, SHA-256 of the rest) when the ranges [a, b) go."""
    kept, removed, runs = remaining(text, a, b)
    return len((text or "").encode()), removed, runs, hashlib.sha256(kept).hexdigest()


def remaining(text: str | None, a: np.ndarray, b: np.ndarray) -> tuple[bytes, int, int]:
    data = (text or "").encode()
    out, at, runs = [], 0, 0
    end = -1
    for x, y in sorted(zip(a, b)):
        if x > end:
            runs += 1
            out.append(data[at:x])
        end = max(end, y)
        at = end
    kept = b"".join([*out, data[at:]]) if runs else data
    return kept, len(data) - len(kept), runs


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, marks): rows as (rid, id, doc_id, text), marks as (rid, a, b): the covered byte ranges of each row.

    Row ids are the same in every scan.
    """
    rid = free_name(docs, "rid")
    rows = numbered(docs, rid).select(F.col(rid).alias("rid"), F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("id"),
                                      F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = candidates(rows, repeated_anchors(rows))
    # Settled ranges pass the shards unchanged, so that the texts are cut into segments once.
    return rows, found.repartition("h").sortWithinPartitions("h").mapInPandas(sort_shard, MARK)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null texts are empty. A null id stands after all others; rows with the same id count in the order of the table, so of repeated rows the first
    keeps its text. Strings are judged on the input, and never cross documents. Extra columns are not read, an empty table gives none.
    """
    rows, marks = repeats(docs, key, text)
    per_row = marks.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("m"))  # bounded by the row's own text

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, *cut(t, *((a, b) if a is not None else ((), ())))) for i, t, a, b in zip(batch["doc_id"], batch["text"], batch["a"], batch["b"])]
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    both = rows.select("rid", F.col("doc_id").cast("string"), "text").join(per_row, "rid", "left").select(
        "doc_id", "text", F.col("m.a").alias("a"), F.col("m.b").alias("b"))
    got = both.mapInPandas(finish, "doc_id STRING, n_bytes LONG, n_removed LONG, n_spans LONG, kept_sha256 STRING")
    return got.withColumn("doc_id", F.col("doc_id").cast("long"))
