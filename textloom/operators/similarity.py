"""Vector similarity: pair scores, verdicts, calibration, length effects, exact top-k search."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import vectors as vx
from textloom.scale import top_k

# Task functions of this module travel with the job, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of query vectors that every task holds during a search.
QUERY_BYTES = 32 << 20
#: Scores or distances that a task computes at once.
HELD_CELLS = 1 << 20
#: Vectors that are scored at once; longer batches are cut.
SEARCH_ROWS = 1 << 12

# Verdict thresholds (similar at least, dissimilar at most) per embedding model.
THRESHOLDS = {"miniLM": (0.60, 0.30), "bge-m3": (0.65, 0.65)}
CALIBRATION_MARGIN = 0.05


def l2_normalize(vectors: DataFrame, key: str = "vec_id", col: str = "embedding") -> DataFrame:
    """Unit vectors with the original length. Map-only."""
    return vectors.withColumn("norm", vx.norm(F.col(col))).select(
        key, "norm", vx.unit(F.col(col), F.col("norm")).alias(col))


def cosine_pairs(pairs: DataFrame, vectors: DataFrame, key: str = "vec_id", col: str = "embedding") -> DataFrame:
    """Cosine of listed pairs (``left_id``, ``right_id``); other pair columns are kept.

    Both joins are keyed by vector id. Lengths are computed once per vector, before the joins.
    """
    side = vectors.select(key, F.col(col).alias("v"), vx.norm(F.col(col)).alias("n"))
    left = side.select(F.col(key).alias("left_id"), F.col("v").alias("_lv"), F.col("n").alias("_ln"))
    right = side.select(F.col(key).alias("right_id"), F.col("v").alias("_rv"), F.col("n").alias("_rn"))
    joined = pairs.join(left, "left_id").join(right, "right_id")
    score = vx.cosine(F.col("_lv"), F.col("_rv"), F.col("_ln"), F.col("_rn"))
    return joined.select(*pairs.columns, score.alias("score"))


def pair_passes(is_similar: Column, score: Column, model: str = "miniLM") -> Column:
    at_least, at_most = THRESHOLDS[model]
    return F.when(is_similar, score >= at_least).otherwise(score <= at_most)


def similarity_verdicts(scored: DataFrame, model: str = "miniLM") -> DataFrame:
    """Does every pair of a class pass its threshold, and how many do?"""
    ok = pair_passes(F.col("is_similar"), F.col("score"), model)
    return scored.groupBy("is_similar").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(ok).alias("passed"), F.bool_and(ok).alias("all_passed"))


def calibrate_threshold(scored: DataFrame, margin: float = CALIBRATION_MARGIN) -> DataFrame:
    """Highest dissimilar score plus a margin."""
    top = F.max(F.when(~F.col("is_similar"), F.col("score")))
    return scored.agg(F.round(top, 6).alias("max_dissimilar"), F.round(top + margin, 6).alias("threshold"))


def similarity_ranges(scored: DataFrame, bucket: str) -> DataFrame:
    """Smallest, largest and mean score per class and length bucket."""
    return scored.groupBy("is_similar", bucket).agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.min("score"), 6).alias("min_score"),
        F.round(F.max("score"), 6).alias("max_score"), F.round(F.avg("score"), 6).alias("avg_score"))


def length_progression(scored: DataFrame, order: str) -> DataFrame:
    """First and last score of each class along ``order`` and the change between them."""
    first, last = F.min_by("score", order), F.max_by("score", order)
    return scored.groupBy("is_similar").agg(
        F.round(first, 6).alias("first_score"), F.round(last, 6).alias("last_score"),
        F.round(last - first, 6).alias("change"))


def topk_similar(queries: DataFrame, corpus: DataFrame, k: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Exact ``k`` most similar corpus vectors for each query vector (ties: lower id).

    ``queries`` has (query_id, vector), ``corpus`` has (vec_id, vector). Every task scores its part of the
    corpus against the broadcast queries by matrix products of ``HELD_CELLS`` scores and keeps only k rows per query, so
    candidate pairs are never written out, and the corpus is neither shuffled nor copied. ``query_bytes`` bounds what is broadcast: the corpus is
    read once for each such share of the queries. ``clusters.ivf_search`` answers large query sets from an inverted file.
    """
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    c = corpus.select("vec_id", F.col("vector").cast("array<double>").alias("vector"))
    size = q.agg(F.coalesce(F.sum(8 * F.size("vector")), F.lit(0))).first()[0]
    shares = max(1, -(-size // query_bytes))
    found = None
    for share in range(shares):
        part = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(shares)) == share).toPandas()
        held = q.sparkSession.sparkContext.broadcast((part["query_id"].to_numpy(), _unit_rows(part["vector"])))
        rows = c.mapInPandas(_search(held, k), "query_id BIGINT, vec_id BIGINT, score DOUBLE")
        found = rows if found is None else found.unionByName(rows)
    return top_k(found.withColumn("score", F.round("score", 9)), ["query_id"], [F.desc("score"), F.asc("vec_id")], k)


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 0))
    m = np.vstack(vectors.to_numpy()).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0.0] = 1.0
    return m / n


def blocks(rows: int, columns: int) -> Iterator[slice]:
    """Shares of ``rows`` whose matrix with ``columns`` columns has ``HELD_CELLS`` cells at most (one row at least)."""
    step = max(1, HELD_CELLS // max(1, columns))
    return (slice(s, min(s + step, rows)) for s in range(0, rows, step))


class _Best:
    """The ``k`` best of what some queries have met so far: query by position, score and id, in this order."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)  # a lower score changes nothing
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        floor = self.floor
        if scores.shape[1] > self.k and (np.isneginf(floor).any() or np.count_nonzero(scores >= floor[:, None]) > scores.size // 16):
            floor = np.fmax(floor, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        row, column = np.nonzero(~(scores < floor[:, None]))
        row, score, ids = np.concatenate((self.row, row)), np.concatenate((self.score, scores[row, column])), np.concatenate((self.id, ids[column]))
        order = np.lexsort((ids, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.score, self.id = row[kept], score[order][kept], ids[order][kept]
        last = self.row[place[kept] == self.k - 1]
        self.floor[last] = np.nan_to_num(self.score[place[kept] == self.k - 1], nan=-np.inf)


def _search(held, k: int):
    def run(batches):
        ids, matrix = held.value
        best: dict[int, _Best] = {}
        shares = list(blocks(len(ids), SEARCH_ROWS))
        for batch in batches:
            for at in blocks(len(batch) if len(ids) else 0, HELD_CELLS // SEARCH_ROWS):
                vec_ids, vectors = batch["vec_id"].to_numpy()[at], _unit_rows(batch["vector"][at])
                for n, s in enumerate(shares):
                    best.setdefault(n, _Best(s.stop - s.start, k)).add(np.round(matrix[s] @ vectors.T, 9), vec_ids)
        for n, found in best.items():
            yield pd.DataFrame({"query_id": ids[shares[n]][found.row], "vec_id": found.id, "score": found.score})
    return run


def centroids(vectors: DataFrame, by: str, col: str = "embedding") -> DataFrame:
    """Mean vector per group.

    Sums are taken per (group, dimension) with map-side combining, so a group that holds a third of all rows
    reaches each reducer as one partial sum per task.
    """
    cells = vectors.select(by, F.posexplode(col).alias("dim", "x"))
    means = cells.groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("cells"))
    return packed.select(by, F.transform("cells", lambda s: F.round(s["x"], 9)).alias("vector"))
