"""Exact Jaccard self-join of word 5-gram sets by grouped prefixes.

Two sets with Jaccard similarity of at least t share an element among the first ``n - ceil(t n) + 1`` of each, in any common order
(prefix filter). The order here puts elements of many documents last, so prefixes hold rare elements.

1. Count, over all documents, in how many sets the elements occur that stand early in hash order; those of ``COMMON`` sets or more are marked in
   bitmaps of fixed size, one for each level. They decide only the order, so their collisions cost nothing but work.
2. Every distinct set sends its prefix. Sets with the same prefix and size form one group, which appears once for each element.
3. The groups of an element are compared with one of them (the pivot), not with each other: that with the largest share of common elements, as the text has that others
   are changed copies of. Group pairs that cannot reach t by size, position or sketch are dropped; the others are expanded to members, whose sets are fetched and
   intersected exactly. That connects most of what belongs together.
4. What is left open are pairs of an element's members that are not connected yet. Those outside of the element's largest component meet the others, and only pairs that
   size, position and sketch allow come out and are intersected. A pair comes out at the first element that its prefixes share, and not again where
   both have seen a common element shortly before.

A sketch is the parity of a set's elements in ``SKETCH`` cells: two sets differ in at least as many elements as their sketches differ in cells. Components are those
of all links, though links inside a component need not all be found. Elements are 64-bit hashes of words under a key that is drawn for each
run.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import LOWER, TEXT_ROWS, chunks, free_name, joined, mix64, numbered, stored, words
from textloom.llm.graph import components

#: Words of a shingle and the least similarity, in hundredths.
WORDS, SIMILAR = 5, 75
#: Share of a set (lowest hashes) that is counted; levels of common elements, each with its document count and the bits of its bitmap.
COUNTED, COMMON = 0.65, ((2, 27), (16, 25), (256, 22))
#: Bits of the bitmap of document ids whose sets are fetched.
DOC_BITS = 26
#: Elements before an open one that its row carries.
EARLIER = 16
#: Cells of a sketch.
SKETCH = 512
IS_WORD = np.array([c != 0x20 and not 0x09 <= c <= 0x0D for c in range(256)])


class WordHashes:
    """64-bit hashes of words: sums of their bytes, each multiplied by a random number for its place in the word. Two different words get equal sums with a
    chance of 2**-56 at most, whatever words a corpus is made of, as long as the key is drawn after it."""

    def __init__(self, key: bytes):
        self.key, self.factors = int.from_bytes(key, "little"), np.zeros(0, np.uint64)

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        longest = int(size.max(initial=0))
        if longest > len(self.factors):  # a longer draw begins with the shorter one
            self.factors = np.random.Philox(key=self.key).random_raw(1 << max(10, longest.bit_length()))
        if not len(start):
            return np.zeros(0, np.uint64)
        at = np.flatnonzero(IS_WORD[data])
        first = np.cumsum(size) - size
        products = (data[at].astype(np.uint64) + np.uint64(1)) * self.factors[at - np.repeat(start, size)]
        return mix64(np.add.reduceat(products, first))


def shingle_sets(texts: list[str | None], hashes: WordHashes, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each text; a shorter text has its whole word sequence, one without words nothing."""
    data, offsets = joined(texts, b" ")
    data = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
    start, end = words(data, IS_WORD)
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(texts)
    one = hashes.of(data, start, end)
    count = np.diff(np.searchsorted(start, offsets))
    first = np.cumsum(count) - count
    rolled = np.full(len(one), n, np.uint64)
    for k in range(min(n, len(one))):
        rolled[:len(one) - k] = (rolled[:len(one) - k] ^ one[k:]) * np.uint64(0x9FB21C651E98DF25 + 2 * k)
        rolled[:len(one) - k] ^= rolled[:len(one) - k] >> np.uint64(32)
    rolled = mix64(rolled)
    out = []
    for a, c in zip(first, count):
        if c >= n:
            s = np.sort(rolled[a:a + c - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif c:
            h = np.array([c], np.uint64)
            for w in one[a:a + c]:
                h = mix64((h ^ w) * np.uint64(0xD6E8FEB86659FD93))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(values: np.ndarray) -> list[int]:
    """Parity of the elements in each cell, as signed 64-bit numbers."""
    odd = np.bincount((values >> np.uint64(7)).astype(np.int64) & (SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def prefix_size(n: int, similar: int = SIMILAR) -> int:
    return n - -(-similar * n // 100) + 1


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits for a sorted set; the first half is never 0."""
    at = np.arange(1, len(values) + 1, dtype=np.uint64)
    one = mix64(values * np.uint64(0x9E3779B97F4A7C15) ^ at).sum(dtype=np.uint64)
    two = mix64((values ^ np.uint64(0xC2B2AE3D27D4EB4F)) * (at * np.uint64(2) + np.uint64(1))).sum(dtype=np.uint64)
    return int(one.astype(np.int64)) or 1, int((two + np.uint64(len(values))).astype(np.int64))


def bit_table(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap of ``2**bits`` bits with the low bits of every hash set; merged by word in Spark, at most 2**(bits - 6) rows come back."""
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    merged = hashes.select(F.shiftright(low, 6).alias("w"), F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))").alias("b")).groupBy("w").agg(
        F.bit_or("b").alias("b"))
    got = merged.toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return table.view(np.uint64)


def marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64(len(table) * 64 - 1)
    return (table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) != 0


def dealt(values: np.ndarray, parts: int, *more: np.ndarray) -> Iterator[tuple]:
    """(part, bytes of its values, bytes of what belongs to them): values with the same hash go to the same part."""
    part = (values >> np.uint64(33)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(ends)):
        at = order[ends[p]:ends[p + 1]]
        yield (int(p), values[at].tobytes(), *(m[at].tobytes() for m in more))


def by_part(batches: Iterator[pd.DataFrame], columns: list[str], kind: type = np.uint64) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Gather the blocks of each part (rows come sorted by part)."""
    now, blocks = None, []
    for batch in batches:
        for row in batch[["part", *columns]].itertuples(index=False):
            if row[0] != now and blocks:
                yield now, [np.frombuffer(b"".join(b), kind) for b in zip(*blocks)]
                blocks = []
            now = row[0]
            blocks.append(row[1:])
    if blocks:
        yield now, [np.frombuffer(b"".join(b), kind) for b in zip(*blocks)]


def part_count(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def common_elements(texts: DataFrame, key: bytes) -> list[np.ndarray]:
    """A bitmap for each level of ``COMMON``: elements that so many sets hold among their first ``COUNTED`` in hash order. Reads (text).

    Counted by the low 32 bits of the hashes, which are all that the bitmaps tell apart.
    """
    parts = part_count(texts.sparkSession)

    def blocks_of(held: list[np.ndarray]) -> pd.DataFrame:
        h = np.concatenate(held)
        return pd.DataFrame(list(dealt(h << np.uint64(32), parts, h.astype(np.uint32))), columns=["part", "_", "h"])[["part", "h"]]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, hashes = [], 0, WordHashes(key)
        for batch in batches:
            all_texts = batch["text"].tolist()
            for part in chunks(all_texts):
                some = [s[:int(np.ceil(COUNTED * len(s)))] for s in shingle_sets(all_texts[part], hashes)]
                held, size = held + some, size + sum(map(len, some))
                if size > 1 << 20:
                    yield blocks_of(held)
                    held, size = [], 0
        if size:
            yield blocks_of(held)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, (h,) in by_part(batches, ["h"], np.uint32):
            h = np.sort(h)
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            c = np.diff(np.append(first, len(h)))
            often = c >= min(level for level, _ in COMMON)
            yield pd.DataFrame({"h": h[first[often]].astype(np.int64), "c": c[often]})

    blocks = texts.select("text").mapInPandas(emit, "part INT, h BINARY").repartition("part").sortWithinPartitions("part")
    counted = stored(blocks.mapInPandas(count, "h LONG, c LONG"), "common", TEXT_ROWS)
    return [bit_table(counted.filter(F.col("c") >= level), "h", bits) for level, bits in COMMON]


#: Numbers are never null here, because pandas would turn a column with nulls into floats.
PASSED = "h LONG, rid LONG, doc_id STRING, n LONG, d1 LONG, d2 LONG, p1 LONG, p2 LONG, w LONG, sk ARRAY<LONG>"
FIRST = PASSED + ", part INT, hs BINARY, rs BINARY, ls BINARY"
PASSED_NAMES, FIRST_NAMES = ([c.split()[0] for c in schema.split(", ")] for schema in (PASSED, FIRST))


def prefixes(rows: DataFrame, common: list[np.ndarray], similar: int, key: bytes) -> DataFrame:
    """A stored table with two kinds of rows. ``d1 <> 0``: one row for each document, with its row id, set size, digests of set and prefix, share of common
    elements ``w`` (in thousandths, summed over the levels) and sketch. Others: the row id of a set that has the element ``h`` in its prefix, and in ``n`` how many elements the set has from there on (itself included);
    only elements of two or more row ids are kept."""
    spark = rows.sparkSession
    parts, sent = part_count(spark), spark.sparkContext.broadcast(common)  # of fixed size, see COMMON

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, hashes = set(), WordHashes(key)
        for batch in batches:
            texts, ids, rids = batch["text"].tolist(), batch["doc_id"].tolist(), batch["rid"].tolist()
            for part in chunks(texts):
                found, held = [], []
                for i, rid, s in zip(ids[part], rids[part], shingle_sets(texts[part], hashes)):
                    d = digest(s)
                    late = sum(marked(table, s).astype(np.int8) for table in sent.value)
                    head = s[np.argsort(late, kind="stable")[:prefix_size(len(s), similar)]] if len(s) else s
                    p = digest(np.sort(head))
                    found.append((0, rid, i, len(s), *d, *p, 1000 * int(late.sum()) // max(1, len(s)), sketch(s), rid % parts, None, None, None))
                    if len(s) and (*p, len(s)) not in seen:  # the group's prefix leaves this task once
                        seen.add((*p, len(s)))
                        held.append((head, rid, len(s)))
                if held:
                    sizes = [len(h) for h, _, _ in held]
                    owner = np.repeat(np.array([r for _, r, _ in held], np.uint64), sizes)
                    left = np.concatenate([np.arange(n, n - k, -1) for k, (_, _, n) in zip(sizes, held)]).astype(np.uint64)
                    found += [(0, 0, None, 0, 0, 0, 0, 0, 0, None, *block) for block in dealt(np.concatenate([h for h, _, _ in held]), parts, owner, left)]
                yield pd.DataFrame(found, columns=FIRST_NAMES)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs = []

        def blocks() -> Iterator[pd.DataFrame]:
            for batch in batches:
                plain = batch["hs"].isna()
                if plain.any():
                    docs.append(batch[plain][PASSED_NAMES])
                yield batch[~plain]

        for _, (h, r, left) in by_part(blocks(), ["hs", "rs", "ls"]):
            order = np.argsort(h, kind="stable")
            h, r, left = h[order], r[order], left[order]
            same = h[1:] == h[:-1]
            keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
            found = pd.DataFrame({"h": h[keep].astype(np.int64), "rid": r[keep].astype(np.int64), "doc_id": pd.Series([None] * int(keep.sum()), dtype=object)})
            yield found.assign(n=left[keep].astype(np.int64), d1=0, d2=0, p1=0, p2=0, w=0, sk=pd.Series([None] * int(keep.sum()), dtype=object))
            while docs:
                yield docs.pop()
        while docs:
            yield docs.pop()

    first = rows.select(F.col("doc_id").cast("string"), "text", "rid").mapInPandas(emit, FIRST)
    return stored(first.repartition("part").sortWithinPartitions("part").mapInPandas(meet, PASSED), "prefixes", TEXT_ROWS)


def fetched_sets(rows: DataFrame, wanted: DataFrame, sets: DataFrame, key: bytes) -> DataFrame:
    """(gid, e): the shingle sets of the groups in ``wanted`` (gid), as sorted hashes. ``sets`` has gid, d1, d2, doc_id of all documents."""
    needed = sets.join(wanted.distinct(), "gid", "left_semi")
    table = bit_table(needed.select(F.xxhash64("doc_id").alias("x")).distinct(), "x", DOC_BITS)
    sent = rows.sparkSession.sparkContext.broadcast(table)  # 2**DOC_BITS bits; what it lets through besides is dropped by the join

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, hashes = set(), WordHashes(key)
        for batch in batches:
            batch = batch[marked(sent.value, batch["x"].to_numpy().view(np.uint64))]
            texts = batch["text"].tolist()
            for part in chunks(texts):
                found = []
                for s in shingle_sets(texts[part], hashes):
                    d = digest(s)
                    if d not in seen:
                        seen.add(d)
                        found.append((*d, s.tobytes()))
                yield pd.DataFrame(found, columns=["d1", "d2", "e"])

    got = rows.select(F.xxhash64(F.col("doc_id").cast("long")).alias("x"), "text").mapInPandas(emit, "d1 LONG, d2 LONG, e BINARY")
    keys = needed.select("gid", "d1", "d2").distinct()
    return stored(got.join(keys, ["d1", "d2"]).groupBy("gid").agg(F.first("e").alias("e")), "sets", TEXT_ROWS)


@F.pandas_udf(T.LongType())
def shared(one: pd.Series, two: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted sets."""
    def size(a: bytes, b: bytes) -> int:
        both = np.concatenate((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
        both.sort(kind="stable")
        return int((both[1:] == both[:-1]).sum())
    return pd.Series([size(a, b) for a, b in zip(one, two)], dtype="int64")


#: Pairs of sets that go to Python at once: bounds the memory of a worker by the size of the sets.
PAIR_ROWS = 500


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """A stored table of ``pairs`` (a, b, na, nb) with the size of their intersection."""
    left = sets.select(F.col("gid").alias("a"), F.col("e").alias("ea"))
    right = sets.select(F.col("gid").alias("b"), F.col("e").alias("eb"))
    both = pairs.select("a", "b", "na", "nb").join(right, "b").join(left, "a")
    return stored(both.select("a", "b", "na", "nb", shared("ea", "eb").alias("inter")), "verified", PAIR_ROWS)


def possible(similar: int, na: Column, nb: Column, most: Column, ska: Column, skb: Column) -> Column:
    """Whether sets of sizes ``na`` and ``nb`` with at most ``most`` common elements and these sketches can be similar enough: all bounds are exact."""
    total = na + nb
    apart = sum((F.bit_count(ska[k].bitwiseXOR(skb[k])) for k in range(SKETCH // 64)), F.lit(0))
    return ((F.least(na, nb) * 100 >= similar * F.greatest(na, nb)) & ((100 + similar) * most >= similar * total)
            & ((100 + similar) * apart <= (100 - similar) * total))


def similar_pairs(rows: DataFrame, pairs: DataFrame, catalog: DataFrame, similar: int, key: bytes) -> DataFrame:
    """A stored table of the links among ``pairs`` (a, b, na, nb), by their sets."""
    sets = fetched_sets(rows, pairs.select(F.explode(F.array("a", "b")).alias("gid")), catalog, key)
    inter = F.col("inter")
    return verified(pairs, sets).filter(100 * inter >= similar * (F.col("na") + F.col("nb") - inter)).select("a", "b")


def open_pairs(spread: DataFrame, similar: int) -> DataFrame:
    """(a, b, na, nb): pairs that are not connected and may be similar, found at their common elements; a pair may come out more than once.

    ``spread``: a row for each member ``gid`` of an element ``h``, with its size ``n``, root, sketch, the elements ``left`` from there on, the last elements ``before`` it,
    and ``main``, the root of the element's largest component. Sets have their elements in one common order. Where both carry an earlier common
    element, the pair is met there, too, and more of the sets is left; so nothing is lost, since at the first common element there is none.
    """
    x = spread.filter("root <> main").select(F.col("h"), F.col("gid").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("root").alias("ra"),
                                             F.col("sk").alias("ska"), F.col("before").alias("ba"))
    y = spread.select(F.col("h").alias("h2"), "main", F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"), F.col("root").alias("rb"),
                      F.col("sk").alias("skb"), F.col("before").alias("bb"))
    fits = possible(similar, F.col("na"), F.col("nb"), F.least("la", "lb"), F.col("ska"), F.col("skb"))
    apart = (F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("main")) | (F.col("a") < F.col("b")))
    return x.join(y, (F.col("h") == F.col("h2")) & apart & fits & ~F.arrays_overlap("ba", "bb")).select("a", "b", "na", "nb")


def similarity_links(rows: DataFrame, similar: int = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(documents, links): documents as (doc_id, n, gid, rid) with one gid for each distinct set; links (a, b) between gids whose components are
    those of all pairs with Jaccard similarity of at least ``similar`` hundredths. ``rows`` has (rid, doc_id, text).

    The row ids are read once."""
    key = os.urandom(16)
    passed = prefixes(rows, common_elements(rows, key), similar, key)
    docs = passed.filter("d1 <> 0").drop("h").withColumn("doc_id", F.col("doc_id").cast("long"))
    first = lambda c: F.first(c).alias(c)
    gids = docs.groupBy("d1", "d2").agg(F.min("rid").alias("gid"), first("n"), first("p1"), first("p2"), first("w"), first("sk"))
    groups = gids.groupBy("p1", "p2", "n").agg(F.max(F.struct("w", "gid")).alias("g")).select("p1", "p2", "n", F.col("g.gid").alias("grp"), F.col("g.w").alias("gw"))
    gids = stored(gids.join(groups, ["p1", "p2", "n"]).select("d1", "d2", "gid", "n", "grp", "gw", "sk"), "groups")
    docs = stored(docs.select("doc_id", "n", "d1", "d2", "rid").join(gids.select("d1", "d2", "gid"), ["d1", "d2"]), "documents")
    catalog = docs.select("gid", "d1", "d2", "doc_id")

    # Postings of groups, for each of which its member with the most common elements stands. A pivot far from the others would leave their pairs open, as many as the square.
    grp_of = docs.select("rid", "gid").join(gids.select("gid", "grp", "gw"), "gid").select("rid", "grp", "gw")
    postings = passed.filter("d1 = 0").select("h", "rid", F.col("n").alias("left")).join(grp_of, "rid").groupBy("h", "grp").agg(
        F.max("left").alias("left"), F.first("gw").alias("gw"))
    pivots = postings.groupBy("h").agg(F.max(F.struct("gw", "grp", "left")).alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    postings = stored(postings.join(pivots, "h").select("h", "grp", "left", F.col("p.grp").alias("pivot"), F.least("left", "p.left").alias("most")), "postings")
    # Sets whose first common element is h share at most the elements from there on; no earlier one shows in another row of the pair.
    near = postings.filter("grp <> pivot").groupBy("pivot", "grp").agg(F.max("most").alias("most"))
    inside = gids.filter("gid <> grp").select(F.col("grp").alias("pivot"), "grp", F.col("n").alias("most")).distinct()
    head = gids.filter("gid = grp").select(F.col("gid").alias("pivot"), F.col("n").alias("na"), F.col("sk").alias("ska"))
    members = gids.select("grp", F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("sk").alias("skb"))
    fits = possible(similar, *map(F.col, ("na", "nb", "most", "ska", "skb")))
    # Group pairs are filtered by size before they are expanded; a member is dropped where it joins.
    sized = near.unionByName(inside).join(head, "pivot").join(gids.filter("gid = grp").select("grp", F.col("n").alias("_n")), "grp").filter(
        (F.least("na", "_n") * 100 >= similar * F.greatest("na", "_n")) & ((100 + similar) * F.col("most") >= similar * (F.col("na") + F.col("_n"))))
    star = sized.join(members, (sized["grp"] == members["grp"]) & fits & (F.col("pivot") != F.col("b")))
    star = stored(star.select(F.col("pivot").alias("a"), "b", "na", "nb").distinct(), "pairs")
    links = stored(similar_pairs(rows, star, catalog, similar, key), "links")

    # Members of an element that are not connected yet: those outside of its largest component, against all others.
    roots = components(links)
    rooted = gids.select("gid", "grp", "n", "sk").join(roots.select(F.col("node").alias("gid"), "root"), "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    rooted = stored(rooted, "rooted")
    spread = postings.select("h", "grp", "left").join(rooted.select("grp", "gid", "root"), "grp")
    counted = spread.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"))
    open_ = counted.groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("h", "main")
    before = Window.partitionBy("grp").orderBy(F.desc("left")).rowsBetween(-EARLIER, -1)
    opened = postings.select("h", "grp", "left").join(open_, "h").withColumn("before", F.collect_list("h").over(before))
    spread = stored(opened.join(rooted, "grp").select("h", "main", "gid", "n", "left", "root", "sk", "before"), "open")
    met = open_pairs(spread, similar)
    more = stored(met.select("a", "b", "na", "nb").distinct(), "open-pairs")
    return docs, links.union(similar_pairs(rows, more, catalog, similar, key))


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Words are runs of other characters than blank and TAB to CR, A-Z as a-z. A text with fewer words than a shingle has its word sequence as
    only element; a null text or one without words has an empty set and links with nothing. Repeated rows come back each; a null id is
    carried through and never names a component that has another id. An empty table gives an empty result; extra columns are not read.
    ``docs`` is read several times and should be a stored table.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("rid"))
    found, links = similarity_links(rows, similar)
    roots = components(links).select(F.col("node").alias("gid"), "root")
    rooted = found.join(roots, "gid", "left").select("doc_id", "n", F.coalesce("root", "gid").alias("root"))
    least = rooted.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: int = SIMILAR) -> DataFrame:
    """One row of each component, with all columns: the smallest id (null last, then the first row of the table).

    Rows with an empty set link with nothing and all stay. Rows are told apart by a number that is the same in every scan.
    """
    names, rid = docs.columns, free_name(docs, "rid")
    docs = numbered(docs, rid)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(rid).alias("rid"))
    found, links = similarity_links(rows, similar)
    roots = components(links).select(F.col("node").alias("gid"), "root")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    kept = found.join(roots, "gid", "left").withColumn("root", F.when(F.col("n") == 0, F.col("rid")).otherwise(F.coalesce("root", "gid")))
    kept = kept.groupBy(F.col("n") == 0, "root").agg(F.min(order).alias("first")).select(F.col("first.rid").alias(rid))
    return docs.join(kept, rid, "left_semi").select(*names)
