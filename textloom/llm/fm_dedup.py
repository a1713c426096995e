"""Removal of words that another document holds already, by FM-indexes of shards.

A word goes when it lies in a window of ``WINDOW`` words that also starts in a document with a smaller id.

1. Every window has an anchor: its run of ``ANCHOR`` words with the smallest hash. Neighbouring windows mostly share one and travel as one segment, to the
   shard of the anchor; equal windows have equal anchors, so no pair of shards must be compared. Each document is read and dealt out once.
2. Equal segments of a task are sent once, with the smallest id that holds them there: a passage that stands in a third of all documents reaches its
   shard once for each scanning task. Anchors that are frequent in a sample are dealt by the whole window instead, so that no shard gathers all
   that stands around a common phrase. The sample only steers the dealing.
3. A shard drops anchors that stand in one segment only, builds FM-indexes of the others, a bounded piece at a time, and streams the segments through them:
   backward search gives the interval of every window, and the interval the smallest id that holds the window.
4. The covered words, packed by document, are joined to the texts and cut out.

Hashes only choose shards. Words are numbered in the shard by their bytes, and equal segments are compared by theirs.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import chunks, mix64, prefix_hash, span_hash, stored, words
from textloom.llm.fm_index import FMIndex
from textloom.llm.periodic_runs import numbered
from textloom.scale import scanned_bytes

WINDOW, ANCHOR = 13, 3
#: Bytes of text whose segments are found at once (a longer text is cut into overlapping pieces), and that are sent in one block for each shard.
TOGETHER, SENT = 1 << 21, 8 << 20
#: Bytes of segments in a shard, and words in an index.
SHARD_BYTES, INDEX_WORDS = 48 << 20, 1 << 19
#: Share of the documents that are sampled for frequent anchors, and the share of anchors that makes one frequent: at most so many are broadcast.
SAMPLED, FREQUENT = 16, 4096

IS_WORD = np.array([c != 0x20 and not 0x09 <= c <= 0x0D for c in range(256)])
BLANK = bytes(0x20 if 0x09 <= c <= 0x0D else c for c in range(256))
LAST = (1 << 63) - 1


def pieces(blob: bytes) -> Iterator[tuple[int, bytes]]:
    """(number of the first word, bytes) of the pieces of a text; neighbours share ``WINDOW - 1`` words, so every window lies in one."""
    if len(blob) <= TOGETHER:
        yield 0, blob
        return
    start, end = words(np.frombuffer(blob, np.uint8), IS_WORD)
    first = 0
    while first < len(start):
        last = int(np.searchsorted(end, start[first] + TOGETHER))
        last = min(max(last, first + 2 * WINDOW), len(start))
        yield first, blob[start[first]:end[last - 1]]
        if last == len(start):
            break
        first = last - WINDOW + 1


def rolled(one: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on."""
    out = np.full(max(len(one) - n + 1, 0), n, np.uint64)
    for k in range(n):
        out = (out ^ one[k:k + len(out)]) * np.uint64(0x9FB21C651E98DF25 + 2 * k)
        out ^= out >> np.uint64(32)
    return mix64(out)


class Segments:
    """The segments of some texts: key, piece, first word, number of windows, byte span in ``data`` and hash of the bytes."""

    def __init__(self, blobs: list[bytes], frequent: np.ndarray):
        blobs = [b.translate(BLANK) for b in blobs]
        offsets = np.zeros(len(blobs) + 1, np.int64)
        np.cumsum([len(b) + 1 for b in blobs], out=offsets[1:])
        self.data = b" ".join([*blobs, b""])
        data = np.frombuffer(self.data, np.uint8)
        start, end = words(data, IS_WORD)
        n = max(len(start) - WINDOW + 1, 0)
        sums = prefix_hash(data)
        one = span_hash(sums, start, end)
        owner = np.searchsorted(offsets, start, "right") - 1
        valid = owner[:n] == owner[len(owner) - n:]
        gram, low = rolled(one, ANCHOR), np.uint64((1 << 31) - 1)
        least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while 2 * width <= WINDOW - ANCHOR + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < WINDOW - ANCHOR + 1:
            rest = WINDOW - ANCHOR + 1 - width
            least = np.minimum(least[:-rest], least[rest:])
        anchor = (least[:n] & low).astype(np.int64)
        key = gram[anchor]
        often = np.isin(key, frequent) if len(frequent) else np.zeros(n, bool)
        if often.any():
            key = np.where(often, rolled(one, WINDOW), key)
        begin = valid.copy()
        begin[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | often[1:]
        first = np.flatnonzero(begin)
        stops = np.append(np.flatnonzero(begin | ~valid), n)
        after = stops[np.searchsorted(stops, first, "right")]
        self.key, self.owner, self.windows = key[first], owner[first], after - first
        self.word = first - np.searchsorted(start, offsets)[self.owner]
        self.a, self.b = start[first], end[after + WINDOW - 2] if n else first
        self.hash = span_hash(sums, self.a, self.b)


def frequent_anchors(rows: DataFrame) -> np.ndarray:
    """Anchors with at least one in ``FREQUENT`` of the segments of a sample (by the hash of the id), so no more than that."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in chunks(texts, TOGETHER):
                cut = [p for t in texts[part] for _, p in pieces(t)]
                for some in chunks(cut, TOGETHER):
                    key, n = np.unique(Segments(cut[some], np.zeros(0, np.uint64)).key, return_counts=True)
                    # A rarer one counts for nothing here, which can only leave an anchor as it is.
                    keep = n * FREQUENT >= n.sum()
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(key[keep].view(np.int64), 0)), pa.array(np.append(n[keep], -n.sum()))],
                                                     names=["key", "n"])

    counted = rows.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(SAMPLED)) == 0).select("text").mapInArrow(count, "key LONG, n LONG")
    total = F.sum(F.when(F.col("n") < 0, -F.col("n")))
    counted = stored(counted.groupBy("key").agg(F.sum(F.when(F.col("n") > 0, F.col("n"))).alias("n"), total.alias("total")), "anchors")
    total = counted.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    got = counted.filter(F.col("n") * FREQUENT >= F.lit(total)).select("key").toArrow()
    return np.sort(got.column("key").to_numpy().view(np.uint64))


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: the group of each member, and its number in the group."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def marks_of(ids: np.ndarray, texts: np.ndarray, first: np.ndarray, after: np.ndarray) -> pd.DataFrame:
    """One row for each document (id, text): its covered word ranges [first, after), united, as pairs of 64-bit numbers."""
    order = np.lexsort((first, texts, ids))
    ids, texts, first, after = ids[order], texts[order], first[order], after[order]
    new_doc = np.concatenate(([True], (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])))[:len(ids)]
    # All ranges but those of whole segments have one length, so the largest end so far is that of the document's earlier ranges.
    far = np.maximum.accumulate(after + (np.cumsum(new_doc) << 40)) - (np.cumsum(new_doc) << 40)
    cut = new_doc | np.concatenate(([True], first[1:] > far[:-1]))[:len(ids)]
    at = np.flatnonzero(cut)
    ranges = np.stack((first[at], far[np.append(at[1:], len(ids))[:len(at)] - 1]), axis=1)
    docs = np.flatnonzero(new_doc[at])
    blobs = [ranges[a:b].tobytes() for a, b in zip(docs, [*docs[1:], len(at)])]
    return pd.DataFrame({"id": ids[at[docs]], "t": texts[at[docs]].astype(np.int64), "m": pd.Series(blobs, dtype=object)})


I64, U32 = np.dtype(np.int64), np.dtype(np.uint32)
#: Columns of a block. Units: shard key, bytes, id. Places: unit (as a step), text, first word. Settled: id, text, first, after. Bytes of the units.
BLOCK = (U32, U32, I64, U32, U32, U32, I64, U32, I64, I64, np.dtype(np.uint8))
LEVEL = 5


def packed(parts: list[list[np.ndarray]]) -> bytes:
    """One compressed block of the columns of some smaller ones."""
    columns = [np.concatenate([np.ascontiguousarray(c, t) for c in column]) for column, t in zip(zip(*parts), BLOCK)]
    head = np.array([len(c) for c in columns], np.int64).tobytes()
    raw = b"".join([head, *(c.tobytes() for c in columns)])
    return len(raw).to_bytes(8, "big") + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def unpacked(block: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(block[8:], int.from_bytes(block[:8], "big"), asbytes=True)
    at, out = 8 * len(BLOCK), []
    for n, t in zip(np.frombuffer(raw, np.int64, len(BLOCK)), BLOCK):
        out.append(np.frombuffer(raw, t, n, at))
        at += n * t.itemsize
    out[3] = np.cumsum(out[3], dtype=np.int64) - 1
    return out


def dealt(cut: list[tuple[int, int, int, bytes]], frequent: np.ndarray, parts: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(shard, columns of a block) for some pieces (id, text, number of the first word, bytes)."""
    s = Segments([c[3] for c in cut], frequent)
    if not len(s.key):
        return
    ids, texts, base = (np.array([c[k] for c in cut], np.int64)[s.owner] for k in range(3))
    word = s.word + base
    # Equal segments: the smallest id is the leader, equal ids are further places of it, larger ones are settled.
    order = np.lexsort((word, ids, s.hash))
    h = s.hash[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    leader = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    a, b, data = s.a, s.b, s.data
    for k in np.flatnonzero(~new):
        x, y = order[k], leader[k]
        if data[a[x]:b[x]] != data[a[y]:b[y]]:
            leader[k] = x  # another text with the same hash goes by itself
    late = ids[order] > ids[leader]
    settled = order[late]
    done = [ids[settled], texts[settled], word[settled], word[settled] + s.windows[settled] + WINDOW - 1]
    place, of = order[~late], leader[~late]
    unit, of = np.unique(of, return_inverse=True)
    part = ((s.key[unit] >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    at = np.argsort(rank[of], kind="stable")
    place, of = place[at], rank[of][at]
    unit, part = unit[by], part[by]
    edges = np.flatnonzero(np.concatenate((part[:1] >= 0, part[1:] != part[:-1])))
    flat = np.frombuffer(data, np.uint8)
    for x, y in zip(edges, [*edges[1:], len(unit)]):
        some = unit[x:y]
        p, q = np.searchsorted(of, (x, y))
        owner, inner = spread(b[some] - a[some])
        yield int(part[x]), [s.key[some] & np.uint64(0xFFFFFFFF), b[some] - a[some], ids[some], np.diff(of[p:q], prepend=x - 1), texts[place[p:q]],
                             word[place[p:q]], *done, flat[a[some][owner] + inner]]
        done = [np.zeros(0, np.int64)] * 4


def searched(segments: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, window, smallest id) for all windows of the distinct ``segments``; ``ids`` are their own smallest ids."""
    codes, offsets = numbered([x.split() for x in segments])
    size = np.diff(offsets) - 1
    index = FMIndex(codes, np.repeat(ids, size + 1), WINDOW, int(codes.max(initial=0)) + 1)
    return index.matches(codes, offsets[1:] - 1, size)


def shard_marks(blocks: list[bytes]) -> Iterator[pd.DataFrame]:
    """The covered word ranges that a shard finds."""
    columns = [unpacked(x) for x in blocks]
    units = [len(c[0]) for c in columns]
    before = np.cumsum([0, *units])
    done = [np.concatenate([c[k] for c in columns]) for k in range(6, 10)]
    if len(done[0]):
        yield marks_of(*done)
    key, ids = (np.concatenate([c[k] for c in columns]) for k in (0, 2))
    at = np.concatenate([c[3] + x for c, x in zip(columns, before)])
    texts, word = (np.concatenate([c[k] for c in columns]) for k in (4, 5))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    wanted = np.zeros(len(key), bool)
    wanted[order] = True
    text = {}
    for c, x in zip(columns, before):
        ends = np.cumsum(c[1])
        data = c[10].tobytes()
        for k in np.flatnonzero(wanted[x:x + len(c[0])]):
            text[x + k] = data[ends[k] - c[1][k]:ends[k]]
    del columns
    place = np.argsort(at, kind="stable")  # places by unit
    at = at[place]
    edges = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))[:len(order)]
    start = held = 0
    for x, y in zip(edges, [*edges[1:], len(order)]):
        held += sum(len(text[u]) for u in order[x:y].tolist()) // 6
        if held < INDEX_WORDS and y < len(order):
            continue
        some, start, held = order[start:y], y, 0
        number: dict[bytes, int] = {}
        kind = np.array([number.setdefault(text.pop(u), len(number)) for u in some.tolist()])
        least = np.full(len(number), LAST)
        np.minimum.at(least, kind, ids[some])
        segment, window, smallest = searched(list(number), least)
        by = np.argsort(segment, kind="stable")
        segment, window, smallest = segment[by], window[by], smallest[by]
        first, after = np.searchsorted(segment, kind), np.searchsorted(segment, kind, "right")
        owner, inner = spread(after - first)
        hit = first[owner] + inner
        owner, hit = (z[smallest[hit] < ids[some][owner]] for z in (owner, hit))
        p, q = np.searchsorted(at, some[owner]), np.searchsorted(at, some[owner], "right")
        of, inner = spread(q - p)
        where = place[p[of] + inner]
        begin = word[where].astype(np.int64) + window[hit[of]]
        if len(begin):
            yield marks_of(ids[some[owner[of]]], texts[where], begin, begin + WINDOW)


def part_count(rows: DataFrame) -> int:
    """Shards of about ``SHARD_BYTES``: a compressed byte of a scan gives some six bytes of segments."""
    spark, size = rows.sparkSession, scanned_bytes(rows)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 4 * least if size >= 1 << 60 else max(least, 6 * size // SHARD_BYTES)


def repeated_words(rows: DataFrame) -> DataFrame:
    """(id, t, m): the covered word ranges of documents, as ``marks_of`` packs them; several rows for a document. ``rows`` has (id, t, text)."""
    parts, frequent = part_count(rows), rows.sparkSession.sparkContext.broadcast(frequent_anchors(rows))  # FREQUENT numbers at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for p in sorted(held):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([packed(held.pop(p))], pa.binary())], names=["part", "block"])

        for batch in batches:
            given = zip(*(c.to_pylist() for c in batch.columns))
            cut = [(i, t, first, piece) for i, t, x in given for first, piece in pieces(x)]
            for some in chunks([c[3] for c in cut], TOGETHER):
                for p, columns in dealt(cut[some], frequent.value, parts):
                    held[p].append(columns)
                size += sum(len(c[3]) for c in cut[some])
                if size >= SENT:
                    yield from flush()
                    size = 0
        yield from flush()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            for frame in shard_marks(blocks) if blocks else ():
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

        for batch in batches:
            for p, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != now:
                    yield from flush()
                    now, blocks = p, []
                blocks.append(block)
        yield from flush()

    blocks = rows.mapInArrow(emit, "part INT, block BINARY").repartition("part").sortWithinPartitions("part")
    return blocks.mapInArrow(search, "id LONG, t LONG, m BINARY")


def kept_words(found: list[bytes], marks: list[bytes] | None) -> list[bytes]:
    """The words that no range covers."""
    if not marks:
        return found
    ranges = np.concatenate([np.frombuffer(m, np.int64) for m in marks]).reshape(-1, 2)
    step = np.zeros(len(found) + 1, np.int64)
    np.add.at(step, ranges[:, 0], 1)
    np.add.at(step, ranges[:, 1], -1)
    return [found[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


SCHEMA = "doc_id LONG, n_words LONG, n_removed LONG, kept_sha256 STRING"


def without_repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by one blank).

    Words are runs of other characters than blank and TAB to CR; windows are judged on the input. Rows that share an id are no smaller than each other; a null id
    counts as the largest long. Null and empty texts have no words; an empty table gives no rows; extra columns are not read. ``docs`` is read three times.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    # The id and 32 bits of a strong digest name a row's text, so rows need no number of their own; rows that agree in both get equal results.
    digest = F.conv(F.substring(F.sha2(body, 256), 1, 8), 16, 10).cast("long")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), digest.alias("t"), body.alias("text"))
    marks = repeated_words(rows).groupBy("id", "t").agg(F.collect_list("m").alias("m"))  # bounded by the document's own words
    ready = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), digest.alias("t"), body.alias("text"))
    ready = ready.join(marks, ["id", "t"], "left").select("doc_id", "text", "m")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, removed, digests = [], [], []
            for x, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = x.split()
                kept = kept_words(found, m)
                count.append(len(found))
                removed.append(len(found) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return ready.mapInArrow(finish, SCHEMA)
