"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.scale import local_table
from textloom.session import shared_dir

MASK64 = (1 << 64) - 1


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a fresh folder below the shared folder of ``spark.checkpoint.dir``."""
    return f"{shared_dir(spark).rstrip('/')}/textloom-{name}-{uuid.uuid4().hex}"


#: Texts that go to Python at once.
TEXT_ROWS = 1000


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Python functions of the jobs that start inside get ``rows`` rows at once: bounds the buffers on both sides, which the JVM keeps for the next jobs."""
    conf, batch = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(batch)
    if rows:
        conf.set(batch, rows)
    try:
        yield
    finally:
        conf.set(batch, before)


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    ``batch_rows`` bounds the rows that Python functions of this job get at once, and so the memory of their workers.
    """
    path = new_folder(df.sparkSession, name)
    with batches_of(df.sparkSession, batch_rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, rid: str) -> DataFrame:
    """``docs`` with a number ``rid`` for each row that is the same in every scan, in the order of the table.

    Rows of Parquet files are numbered by file (in the order of the paths) and place in it, which no split changes. Other tables are written once with
    their numbers: what a scan would count depends on its splits, and these on the executors.
    """
    try:
        files = sorted(r[0] for r in docs.select(F.col("_metadata.file_path"), F.col("_metadata.row_index")).select("file_path").distinct().collect())
    except AnalysisException:
        return stored(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    path, index = free_name(docs, "file_path"), free_name(docs, "row_index")
    names = local_table(docs.sparkSession, [(f, k) for k, f in enumerate(files)], f"{path} STRING, {rid} LONG")
    rows = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(index))
    rows = rows.join(F.broadcast(names), path)  # one short row for each file, as the scan itself has on the driver
    return rows.withColumn(rid, F.col(rid) * F.lit(1 << 40) + F.col(index)).drop(path, index)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits (in place when possible)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least ``n`` of each."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[0] = have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return have


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of a byte array; ``span_hash`` turns them into hashes of any span."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end): equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def joined(texts: list[str | bytes | None], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts with ``gap`` after each, and the offset of each text (one more at the end)."""
    blobs = [t if isinstance(t, bytes) else t.encode("utf-8", "replace") if t else b"" for t in texts]
    offsets = np.zeros(len(blobs) + 1, np.int64)
    np.cumsum([len(b) + len(gap) for b in blobs], out=offsets[1:])
    return np.frombuffer(gap.join([*blobs, b""]), np.uint8), offsets


def chunks(texts: list, budget: int = 1 << 19):
    """Slices of the list that hold about ``budget`` characters each (a longer text stands alone)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= budget:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def words(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes for which ``is_word[byte]`` holds."""
    edge = np.zeros(len(data) + 2, np.int8)
    edge[1:-1] = is_word[data]
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
