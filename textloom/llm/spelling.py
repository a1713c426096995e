"""Spelling variants: exact neighbours of words at edit distance 1, by pairs of trie nodes.

1. Words are counted over all documents; those of ``LETTERS`` code points and ``OCCURRENCES`` or more make the vocabulary.
2. The nodes of the trie of all words, and of the trie of all reversed words, get numbers. Words are dealt to ranges of their order, cut at sampled words; a
   node on the path of such a cut is numbered there, all others have all their words in one range and are numbered in it.
3. A word of n letters has a pair (prefix node, suffix node) for each letter that is skipped and for each gap between letters. Words with equal pairs of
   the first kind differ in that letter; a pair of the first kind that equals one of the second tells that the letter is missing in the other word.
   A pair leaves one letter open, so that no more words share it than there are letters, and one: no key is hot, and none is expanded to pairs of words.
4. Each word takes the most frequent neighbour as its form if it is frequent enough; roots follow from forms by pointer doubling.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import LOWER, stored

LETTERS, OCCURRENCES, TIMES = 5, 3, 2
#: Words that a task counts before it hands them on, words of a range, and sampled words for each range.
HELD, RANGE, DRAWN = 200_000, 50_000, 64
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def planted(doc_id: int | None, run: str) -> str:
    """The run with a code point less for one in 97, as the query's contract states. A null id counts as the empty text."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", change=None, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of all words that are long and frequent enough. ``change`` (doc_id, run) may rewrite the runs of a document."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for run, n in Counter(RUN.findall(t.translate(LOWER).decode("utf-8", "replace"))).items():
                    word = change(i, run) if change else run
                    if len(word) >= letters:
                        held[word] += n
                if len(held) > HELD:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(count, "word STRING, n LONG").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


def paths(words: Iterable[str], base: int, edges: tuple = ()) -> Iterator[list[int]]:
    """Numbers of the nodes on the path of every word, from the root on; words come in order. ``edges``: words whose paths are numbered already, with these."""
    last, path, free = "", [], base
    for word in words:
        path = path[:shared(last, word) + 1] if path else path
        for other, known in edges:
            k = shared(other, word) + 1
            if k > len(path):
                path = path + known[len(path):k]
        fresh = len(word) + 1 - len(path)
        path = path + list(range(free, free + fresh))
        free, last = free + fresh, word
        yield path


def numbered_nodes(words: DataFrame, cuts: list[str], backward: bool) -> DataFrame:
    """(word, id, path): the node numbers of every word in the trie of all words, or of all reversed ones. Ids follow the order of the words.

    ``cuts`` are in order and begin with the empty word: range k holds the words from cut k on.
    """
    sent = words.sparkSession.sparkContext.broadcast((cuts, list(paths(cuts, 0))))  # DRAWN words a range were read, one is kept

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = sent.value[0]
        for batch in batches:
            found = [w[::-1] if backward else w for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(bounds, w) - 1 for w in found], pa.int64()), pa.array(found, pa.string())],
                                             names=["part", "word"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, known = sent.value
        now = walk = None
        word = [""]

        def given() -> Iterator[str]:
            while True:
                yield word[0]

        for batch in batches:
            ids, out, rows = [], [], batch.column(1).to_pylist()
            for p, word[0] in zip(batch.column(0).to_pylist(), rows):
                if p != now:
                    now, rank = p, 0
                    walk = paths(given(), (p + 1) << 40, tuple(zip(bounds[p:p + 2], known[p:p + 2])))
                ids.append((p << 40) + rank)
                out.append(next(walk))
                rank += 1
            yield pa.RecordBatch.from_arrays([pa.array([w[::-1] for w in rows] if backward else rows, pa.string()), pa.array(ids, pa.int64()),
                                              pa.array(out, pa.list_(pa.int64()))], names=["word", "id", "path"])

    ranged = words.select("word").mapInArrow(deal, "part LONG, word STRING").repartition(len(cuts), "part").sortWithinPartitions("part", "word")
    return ranged.mapInArrow(number, "word STRING, id LONG, path ARRAY<LONG>")


def cut_words(sample: list[str], ranges: int) -> list[str]:
    ordered = sorted(set(sample))
    return sorted({"", *(ordered[k * len(ordered) // ranges] for k in range(1, ranges) if ordered)})


def node_pairs(words: DataFrame) -> DataFrame:
    """(word, n, id, before, behind) of every row of ``words`` (word, n), a stored table: the node numbers of its prefixes and suffixes, by length."""
    size = words.count()
    ranges = max(1, -(-size // RANGE))
    step = max(1, size // (DRAWN * ranges))
    drawn = [r.word for r in words.filter(F.pmod(F.xxhash64("word", F.lit(7)), F.lit(step)) == 0).select("word").toLocalIterator()]
    before = numbered_nodes(words, cut_words(drawn, ranges), False).withColumnRenamed("path", "before")
    behind = numbered_nodes(words, cut_words([w[::-1] for w in drawn], ranges), True).select("word", F.col("path").alias("behind"))
    return words.join(before, "word").join(behind, "word")


def best(members: Column) -> Column:
    """Neighbour with most occurrences, the smallest word among equals, as (n, negative id)."""
    return F.array_max(F.transform(members, lambda m: F.struct(m["n"].alias("n"), (-m["id"]).alias("less"))))


def neighbours(nodes: DataFrame) -> DataFrame:
    """(id, n_near, best): number and best of the words at distance 1 of every word that has any."""
    size = F.length("word")
    # A skipped letter leads to the shorter word once for each equal letter beside it; only the last of these counts.
    last = lambda i: F.col("word").substr(i + 1, F.lit(1)) != F.col("word").substr(i + 2, F.lit(1))
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        F.get("before", i).alias("p"), F.get("behind", size - 1 - i).alias("s"), F.lit(True).alias("skip"), last(i).alias("last")))
    gaps = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(
        F.get("before", i).alias("p"), F.get("behind", size - i).alias("s"), F.lit(False).alias("skip"), F.lit(False).alias("last")))
    keyed = nodes.select("id", "n", F.explode(F.concat(skips, gaps)).alias("e")).select("e.*", "id", "n")
    group = keyed.groupBy("p", "s").agg(F.collect_list(F.struct("id", "n", "skip", "last")).alias("m")).filter(F.size("m") > 1)
    skipped = F.filter("m", lambda x: x["skip"])
    group = group.withColumn("skipped", skipped).withColumn("longer", F.filter("m", lambda x: x["last"])).withColumn("shorter", F.filter("m", lambda x: ~x["skip"]))
    group = group.withColumn("top", F.slice(F.sort_array(F.transform("skipped", lambda m: F.struct(
        m["n"].alias("n"), (-m["id"]).alias("less"))), asc=False), 1, 2)).withColumn("top_longer", best(F.col("longer")))
    each = group.select(F.explode("m").alias("x"), "top", F.size("skipped").alias("c"), F.size("longer").alias("d"), "top_longer",
                        F.get("shorter", F.lit(0)).alias("v"))
    other = F.when(F.get("top", F.lit(0))["less"] == -F.col("x.id"), F.get("top", F.lit(1))).otherwise(F.get("top", F.lit(0)))
    shorter = F.when(F.col("x.last") & F.col("v").isNotNull(), F.struct(F.col("v.n").alias("n"), (-F.col("v.id")).alias("less")))
    near = F.when(F.col("x.skip"), F.col("c") - 1 + shorter.isNotNull().cast("int")).otherwise(F.col("d"))
    top = F.when(F.col("x.skip"), F.array_max(F.array(other, shorter))).otherwise(F.col("top_longer"))
    return each.select(F.col("x.id").alias("id"), near.alias("near"), top.alias("best")).filter("near > 0").groupBy("id").agg(
        F.sum("near").cast("long").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): the last word that the forms (id, form) lead to. Occurrences grow along a form, so the way ends."""
    now = stored(forms.select("id", F.col("form").alias("root")), "forms")
    while True:
        step = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("id", "root")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", change=None, letters: int = LETTERS, occurrences: int = OCCURRENCES,
                      times: int = TIMES) -> DataFrame:
    """One row for each word of the vocabulary: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters (ASCII and U+00C0 to U+00FF), A-Z as a-z. The form of a word is its neighbour of most occurrences (ties: the smallest),
    if that has ``times`` its own. Null and empty texts have no words; repeated rows count each; a null id only matters to ``change``; an empty
    table gives no rows; extra columns are not read. Words of any length are numbered; a word takes memory in proportion to its letters.
    """
    words = stored(vocabulary(docs, key, text, change, letters, occurrences), "vocabulary")
    nodes = stored(node_pairs(words), "nodes")
    near = nodes.select("id", "word", "n").join(neighbours(nodes), "id", "left")
    form = F.when(F.col("best.n") >= times * F.col("n"), -F.col("best.less"))
    near = stored(near.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form")), "near")
    some = near.filter("form IS NOT NULL")
    names = lambda c: nodes.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"), F.col("n").alias(f"{c}_n"))
    led = some.join(roots(some), "id").join(names("form"), "form").join(names("root"), "root").select(
        "word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
    alone = near.filter("form IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near",
                                               F.lit(None).cast("long").alias("form_n"))
    return led.union(alone)
