"""Exact top-k by inner product without random access (NRA) over sorted lists.

Each task builds, for every block of its vectors, one list per dimension sorted by component. A query reads the lists it needs from their
better end (the high end where its own component is positive, the low end where it is negative), all to the same depth. What has been
read gives every vector a lower and an upper score: unread components lie between the list's worst value and the last one read. Once no
vector outside a short list can still reach the k-th lower score (of this block or of blocks before), the scores of that list are
resolved. All queries of a chunk go through a block together, as matrix products.

Queries are a stated set; they are sent in chunks of at most ``QUERY_BYTES``, and each chunk reads the vectors once. A task returns at
most k rows for each query, a window over (query, score) keeps the best of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import stored

#: Vectors of one block, queries that pass a block together, and bytes of the queries that are sent at once (a bound of the broadcast).
BLOCK_ROWS, QUERY_ROWS, QUERY_BYTES = 8192, 256, 32 << 20
#: Depths to which lists are read before the bounds are compared, as shares of their length.
DEPTHS = (0.25, 0.5, 0.75, 1.0)
#: A short list is resolved when it has at most so many vectors for each wanted one.
SHORT = 8
#: Integers up to here are exact in float64.
EXACT = float(1 << 53)

FOUND = "query_id LONG, vec_id LONG, score LONG"


def matrix(column: pa.Array, scale: float) -> np.ndarray:
    """Rows of ``floor(scale * x)`` as float64; shorter vectors are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of one query with rows; beyond 64 bits the score stays at the end of the range."""
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(len(q), 1) < EXACT:
        return (c @ q).astype(np.int64)
    ints = [int(x) for x in q]
    top = (1 << 63) - 1
    return np.array([max(-top - 1, min(top, sum(a * int(b) for a, b in zip(ints, row)))) for row in c], np.int64)


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * queries

    def floor(self) -> np.ndarray:
        """The k-th score of each query, or minus infinity while there are fewer."""
        return np.array([float(s[-1]) if len(s) == self.k else -np.inf for s, _ in self.rows])

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.rows[q][0], score]), np.concatenate([self.rows[q][1], ids])
        keep = np.lexsort((ids, -score.astype(object) if score.min(initial=0) == -(1 << 63) else -score))[:self.k]
        self.rows[q] = score[keep], ids[keep]


class Lists:
    """One block: its vectors, and for each dimension the rank of every vector from either end of the sorted list."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.c, n = ids, vectors, len(ids)
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.up = np.empty(vectors.shape, np.int32)
        np.put_along_axis(self.up, self.order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        self.low, self.high = vectors.min(axis=0, initial=np.inf), vectors.max(axis=0, initial=-np.inf)

    def read(self, depth: int) -> tuple[np.ndarray, ...]:
        """Component bounds after reading ``depth`` entries from the high end (upper, lower) and from the low end (upper, lower).

        For the high end an unread component is at most the last value read and at least the worst of the list; for the low end (read for
        negative query components) the roles are swapped.
        """
        n, cols = len(self.ids), np.arange(self.c.shape[1])
        from_high, from_low = self.up >= n - depth, self.up < depth
        last_high, last_low = self.c[self.order[n - depth], cols], self.c[self.order[depth - 1], cols]
        return (np.where(from_high, self.c, last_high), np.where(from_high, self.c, self.low),
                np.where(from_low, self.c, last_low), np.where(from_low, self.c, self.high))

    def search(self, ids: np.ndarray, q: np.ndarray, best: Best, first: int) -> None:
        """Bring the queries ``q`` (numbers from ``first`` on) through this block."""
        n, k = len(self.ids), best.k
        left, kth = np.arange(len(q)), best.floor()[first:first + len(q)]
        safe = np.abs(q).max(initial=0) * np.abs(self.c).max(initial=0) * max(q.shape[1], 1) < EXACT
        for share in DEPTHS if safe else ():
            depth = max(1, int(np.ceil(n * share)))
            high_up, high_lo, low_up, low_lo = self.read(depth)
            plus, minus = np.maximum(q[left], 0), np.minimum(q[left], 0)
            upper, lower = plus @ high_up.T + minus @ low_up.T, plus @ high_lo.T + minus @ low_lo.T
            own = self.ids[None, :] == ids[left][:, None]
            upper[own] = lower[own] = -np.inf
            floor = kth[left]
            if n >= k:
                floor = np.maximum(floor, np.partition(lower, n - k, axis=1)[:, n - k])
            open_ = (upper >= floor[:, None]) & ~own
            count = open_.sum(axis=1)
            done = (count <= SHORT * k) | (depth == n)
            for row in np.flatnonzero(done & (count > 0)):
                at = np.flatnonzero(open_[row])
                best.add(first + left[row], inner(q[left[row]], self.c[at]), self.ids[at])
            left = left[~done]
            if not len(left):
                return
        for row in left:  # integers too large for the bounds: every vector of the block is resolved
            at = np.flatnonzero(self.ids != ids[row])
            best.add(first + row, inner(q[row], self.c[at]), self.ids[at])


def searched(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, scale: float) -> DataFrame:
    """The k best of every partition of ``vectors`` (vec_id, vector) for each of the sent queries."""
    sent = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        best = Best(len(ids), k)

        def block(parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
            width = max([q.shape[1], *(v.shape[1] for _, v in parts)])
            lists = Lists(np.concatenate([i for i, _ in parts]), np.concatenate([widened(v, width) for _, v in parts]))
            for at in range(0, len(ids), QUERY_ROWS):
                lists.search(ids[at:at + QUERY_ROWS], widened(q[at:at + QUERY_ROWS], width), best, at)

        parts, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                parts.append((some.column(0).to_numpy(), matrix(some.column(1), scale)))
                rows += some.num_rows
                if rows >= BLOCK_ROWS:
                    block(parts)
                    parts, rows = [], 0
        if rows:
            block(parts)
        sizes = [len(s) for s, _ in best.rows]
        if sum(sizes):
            yield pa.RecordBatch.from_pydict({
                "query_id": np.repeat(ids, sizes), "vec_id": np.concatenate([i for _, i in best.rows]),
                "score": np.concatenate([s for s, _ in best.rows])})

    return vectors.mapInArrow(search, FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, key: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``vectors`` with the highest inner product for each row of ``queries``.

    Components x enter as ``floor(scale * x)``. Equal scores go to the smaller id. Rows with the query's own id are no candidates for it.
    Rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part on either side. Shorter vectors count
    as filled with zeros. A query id that stands in several rows is asked once, with the smallest of its vectors; a repeated
    candidate row is found as often as it stands there. Scores outside 64 bits are held at the end of the range.
    """
    spark = vectors.sparkSession
    finite = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    slim = [F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")]
    rows = vectors.filter(finite).select(*slim)
    asked = stored(queries.filter(finite).select(*slim).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    size = asked.agg(F.coalesce(F.sum(F.size("v") * 8 + 8), F.lit(0))).first()[0]
    chunk_count = max(1, -(-size // QUERY_BYTES))
    results = []
    for chunk in range(chunk_count):  # each chunk is bounded by QUERY_BYTES, up to the evenness of the hash
        some = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunk_count)) == chunk).toArrow()
        if some.num_rows:
            q = matrix(some.column(1), scale)
            results.append(stored(searched(rows, some.column(0).to_numpy(), q, k, scale), "found"))
    if not results:
        return spark.createDataFrame([], "query_id LONG, rank INT, vec_id LONG, score LONG")
    found = reduce(DataFrame.unionAll, results)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(c.c AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""
