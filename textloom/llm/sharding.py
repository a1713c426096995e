"""Sharding by sampled splitters: shards of near-equal bytes in key order.

1. A slim table (key, tie, size) is written once; the text is read but never shuffled.
2. Rows are drawn with a chance in proportion to their size, and quantiles of the drawn keys become splitters.
3. Rows are range-partitioned by the splitters. Ranges that came out overfull are split again by rank, so the cut does not
   depend on the luck of the sample.
4. Running byte totals over the ranges give every row its place in the global key order; shard ``s`` holds the rows whose
   middle byte lies in the ``s``-th of ``shards`` equal parts of all bytes.

The sample decides only how the work is dealt out. The result depends on keys and sizes alone: every shard differs from the
mean by less than the largest record.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import stored
from textloom.scale import local_table

#: Bytes that every record takes besides its text.
RECORD_BYTES = 16
#: Rows that one range should hold, and the drawn keys for each range.
RANGE_ROWS, DRAWS = 500_000, 32
#: Most ranges, and so a bound of the splitters on the driver: RANGE_LIMIT * DRAWS drawn keys. Beyond it ranges grow.
RANGE_LIMIT = 20_000


def record_size(text: str = "text"):
    """UTF-8 bytes of the text (null: none) plus ``RECORD_BYTES``."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + RECORD_BYTES).cast("long")


def text_crc32(text: str = "text"):
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def splitters(slim: DataFrame, ranges: int, total: int, seed: int = 7) -> list[tuple[int, int]]:
    """``ranges - 1`` quantile boundaries of a size-weighted sample of the (key, tie) pairs."""
    draws = ranges * DRAWS
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(draws / max(total, 1)))
    coin = (F.xxhash64("key", "tie", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    drawn = slim.filter(coin < chance).groupBy("key", "tie").agg(F.max("size").alias("size"))
    # A row larger than a draw stands for several draws.
    got = sorted((r.key, r.tie, max(1.0, r.size * draws / max(total, 1))) for r in drawn.toLocalIterator())
    if not got:
        return []
    ends = list(accumulate(w for _, _, w in got))
    at = np.searchsorted(ends, np.arange(1, ranges) * ends[-1] / ranges)
    return sorted({got[min(int(i), len(got) - 1)][:2] for i in at})


def range_of(cuts: list[tuple[int, int]]):
    """Vectorized number of the range a (key, tie) pair lies in: how many cuts are not above it."""
    keys = np.array([k for k, _ in cuts], np.int64)

    @F.pandas_udf("int")
    def number(key: pd.Series, tie: pd.Series) -> pd.Series:
        k = key.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for i in np.flatnonzero(low < high):  # the key itself is a cut: its ties decide
            high[i] = bisect_right(cuts, (int(k[i]), int(tie.iloc[i])), int(low[i]), int(high[i]))
        return pd.Series(high.astype(np.int32))

    return number


def shard_by_bytes(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal all rows into ``shards`` contiguous key ranges of near-equal bytes.

    Returns ``key``, size, text_crc32, law (``bytes``), shard (0 .. shards - 1), slot (gapless from 0 inside a shard, in key
    order) and grown_shard (null: that figure belongs to another law). Other columns of ``docs`` are not touched.

    * A null key sorts before all others, a null text has no bytes; both rows are kept.
    * Equal keys are ordered by the CRC of the text, then by a drawn row number: rows equal in both are interchangeable.
      One key may hold any share of the rows; its ties are cut like everything else.
    * An empty table gives an empty table. A record larger than a shard leaves neighbouring shards empty.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    crc = text_crc32(text)
    slim = docs.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("key"),
        record_size(text).alias("size"), crc.alias("crc"),
        (F.shiftleft(crc, 31) + F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 31) - 1))).alias("tie"))
    slim = stored(slim, "shard-slim")
    rows, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(RANGE_LIMIT, max(4 * shards, -(-rows // RANGE_ROWS)))
    cuts = splitters(slim, ranges, total)
    ranged = slim.withColumn("rng", range_of(cuts)("key", "tie"))
    ranged = subdivided(ranged, rows, total, ranges)
    ranged = stored(ranged, "shard-ranged")
    measured = ranged.groupBy("rng", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    sizes = sorted((r.rng, r.part, r.n, r.b) for r in measured.toLocalIterator())
    starts, n0, b0 = [], 0, 0
    for rng, part, n, b in sizes:
        starts.append((rng, part, n0, b0))
        n0, b0 = n0 + n, b0 + b
    starts = local_table(docs.sparkSession, starts, "rng INT, part INT, n0 LONG, b0 LONG")
    here = Window.partitionBy("rng", "part").orderBy("key", "tie")
    placed = ranged.select(
        "*", F.row_number().over(here).alias("n_in"),
        F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("b_in"))
    # Bounded: one row for each range, see RANGE_LIMIT.
    placed = placed.join(F.broadcast(starts), ["rng", "part"])
    middle2 = 2 * (F.col("b0") + F.col("b_in")) - F.col("size")
    # decimal, so that the product cannot overflow
    shard = F.expr(f"CAST(m2 * CAST({shards} AS DECIMAL(10,0)) DIV {2 * max(total, 1)} AS INT)")
    placed = placed.withColumn("m2", middle2.cast("decimal(24,0)")).withColumn("shard", shard)
    placed = placed.withColumn("place", F.col("n0") + F.col("n_in") - 1)
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # at most ``shards`` rows
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def subdivided(ranged: DataFrame, rows: int, total: int, ranges: int) -> DataFrame:
    """Number the parts of every range: overfull ranges are cut again at quantiles of their own keys.

    A range is overfull with more than twice the mean bytes or rows. New cuts come from a sample of that range alone, with
    as many draws for each of its parts as the first round took for a range.
    """
    measured = ranged.groupBy("rng").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()  # one row a range
    parts = {r.rng: max(r.n * ranges // max(rows, 1), r.b * ranges // max(total, 1)) for r in measured}
    parts = {k: min(v, RANGE_LIMIT) for k, v in parts.items() if v > 2}
    ranged = ranged.withColumn("part", F.lit(0))
    for rng, k in parts.items():
        one = ranged.filter(F.col("rng") == rng)
        share = next(r for r in measured if r.rng == rng)
        chance = F.least(F.lit(1.0), F.lit(k * DRAWS / share.n))
        coin = (F.xxhash64("key", "tie", F.lit(11)).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
        got = sorted((r.key, r.tie) for r in one.filter(coin < chance).select("key", "tie").toLocalIterator())
        cuts = sorted({got[len(got) * i // k] for i in range(1, k)}) if got else []
        ranged = ranged.withColumn(
            "part", F.when(F.col("rng") == rng, range_of(cuts)("key", "tie")).otherwise(F.col("part")))
    return ranged
