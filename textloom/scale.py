"""Helpers that keep the physical plans healthy when the tables grow."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest lookup table (rows) that is ever sent to every executor.
BROADCAST_ROWS = 2_000_000


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Small literal table. It becomes a local relation of known size, with no Python workers involved."""
    fields = T._parse_datatype_string(schema).fields
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    types = {"string": pa.string(), "double": pa.float64(), "integer": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    arrays = [pa.array(list(c), types[f.dataType.typeName()]) for c, f in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=[f.name for f in fields]))


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when it is proven to hold at most ``max_rows`` rows, else leave the join to Spark.

    Tables whose plan already bounds their rows need no job. Otherwise the probe reads at most
    ``max_rows + 1`` rows, so it is cheap even when the table is huge. An unhinted table is joined by a
    shuffle, where adaptive execution splits hot keys.
    """
    known = df._jdf.queryExecution().optimizedPlan().maxRows()
    if known.isDefined():
        return F.broadcast(df) if known.get() <= max_rows else df
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


#: Scanned bytes per partition that ``cluster_by`` aims at.
CLUSTER_BYTES = 8 * 1024 * 1024


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` scans, as the plan estimates them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def partitions_for(df: DataFrame) -> int:
    """Partition count from the bytes of the tables ``df`` scans: two per core at least.

    Tables that need more than these have ``spark.sql.shuffle.partitions`` at least: with fewer, Spark would lay out the tokens anew for a join by the same key.
    Inputs of unknown size (Spark reports the largest long) fall back to that setting, too.
    """
    spark = df.sparkSession
    floor = 2 * spark.sparkContext.defaultParallelism
    size = scanned_bytes(df)
    if size // CLUSTER_BYTES <= 1:
        return floor
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")), 0 if size >= 2 ** 60 else size // CLUSTER_BYTES)


def cluster_by(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle the compact rows once so that every later group or window on ``keys`` needs no exchange.

    Used on raw documents *before* they are exploded to tokens: the text is several times smaller than its
    tokens, and aggregates keyed by (key, anything) as well as windows over key reuse this layout. The number
    of partitions is explicit because adaptive coalescing sees only the compact bytes, not the tokens to come.
    """
    return df.repartition(partitions_for(df), *[F.col(k) for k in keys])


#: Largest table that is dealt out over the cores by a shuffle.
SPREAD_BYTES = 64 * 1024 * 1024


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a file or two out over the cores; anything above ``SPREAD_BYTES`` is used as it is scanned.

    A small table is often one Parquet row group, which no split size can divide. At most ``SPREAD_BYTES`` are ever shuffled, however many
    cores there are, so every larger table stays map-only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if scanned_bytes(df) > SPREAD_BYTES or df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores, *[F.col(k) for k in keys])


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every group.

    The direct ``row_number() <= k`` filter lets Spark cut each group to ``k`` rows in every map task before
    the shuffle, so a hot group sends k rows per task instead of all its rows.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def ordered_rank(df: DataFrame, by: str, order: str, rank: str, chunk: int = 1_000_000) -> DataFrame:
    """Rank (from 1) of each row inside ``by``, ordered by the unique integer ``order``, safe for hot groups.

    A plain window would sort a hot group in one task. Here the order column is cut into ranges: rows are
    ranked inside (group, range), where a range holds at most ``chunk`` rows, and the sizes of the preceding
    ranges of the group are added from a small per-range count table.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / F.lit(chunk)).cast("long"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(by, "_range").orderBy(order)
    ranked = ranged.withColumn("_pos", F.row_number().over(inner))
    return (ranked.join(offsets, [by, "_range"])
            .withColumn(rank, (F.col("_pos") + F.col("_offset")).cast("long"))
            .drop("_range", "_pos", "_offset"))
