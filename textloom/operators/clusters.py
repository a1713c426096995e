"""K-means by own rounds, and inverted-file search over its cells.

Rounds add up coordinates in whole billionths, in the task that reads them, so that centres do not depend on the layout of the table. Only centres (a bounded
matrix), candidate seeds and cell sizes come to the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.similarity import blocks, l2_normalize, topk_similar
from textloom.scale import top_k

# Task functions of this module travel with the job, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNITS = 1_000_000_000
#: Rounds of oversampled seeding, drawn candidates for each wanted centre in a round, and most rounds of moving centres.
SEED_ROUNDS, OVERSAMPLE, ROUNDS = 5, 2, 20
#: Inverted file: vectors that the cells are learned from at most, most cells, vectors of a cell that a task holds at once, and cells that a query asks at least.
TRAIN_ROWS, MOST_CELLS, HELD_ROWS, PROBES = 100_000, 4096, 50_000, 16
#: Queries whose exact neighbours tell how many cells must be asked, and the share of these neighbours that the cells must hold.
TRIAL_QUERIES, TRIAL_RECALL = 200, 0.96


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, rounded so that equal ones are equal."""
    return np.round(np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0.0), 9)


def assigned(vectors: DataFrame, centers: np.ndarray, nearest: int = 1) -> DataFrame:
    """(key, cluster, distance): the ``nearest`` centres of every row of ``vectors`` (key, vector); of equally near ones the first."""
    sent = vectors.sparkSession.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            for s in blocks(len(x), len(sent.value)):
                d = distances(x[s], sent.value)
                best = np.argsort(d, axis=1, kind="stable")[:, :nearest]
                keys = batch.column(0).take(pa.array(np.repeat(np.arange(s.start, s.stop), best.shape[1])))
                yield pa.RecordBatch.from_arrays([keys, pa.array(best.ravel().astype(np.int32)), pa.array(np.take_along_axis(d, best, 1).ravel())],
                                                 names=["key", "cluster", "distance"])

    return vectors.select("key", "vector").mapInArrow(assign, "key LONG, cluster INT, distance DOUBLE")


def moved(vectors: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Means of the rows that are nearest to each centre; a centre without rows stays."""
    sent = vectors.sparkSession.sparkContext.broadcast(centers)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(sent.value.shape, np.int64), np.zeros(len(sent.value), np.int64)
        for batch in batches:
            x = matrix(batch.column(0))
            at = np.concatenate([np.zeros(0, np.int64), *[distances(x[s], sent.value).argmin(1) for s in blocks(len(x), len(sent.value))]])
            np.add.at(sums, at, np.rint(x * UNITS).astype(np.int64))
            counts += np.bincount(at, minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts), pa.array(list(sums))], names=["cluster", "n", "sums"])

    parts = vectors.select("vector").mapInArrow(add, "cluster INT, n LONG, sums ARRAY<LONG>")
    exact = F.sum(F.col("s").cast("decimal(38,0)"))
    rows = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim").agg(exact.alias("s"), F.sum("n").alias("n")).collect()
    out = centers.copy()
    for r in rows:
        if r["n"]:
            out[r["cluster"], r["dim"]] = round(int(r["s"]) / UNITS / r["n"], 9)
    return out


def lloyd(vectors: DataFrame, centers: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centres after ``rounds`` rounds, or as soon as none of them moves."""
    for _ in range(rounds):
        new = moved(vectors, centers)
        if np.array_equal(new, centers):
            break
        centers = new
    return centers


def labelled_centers(vectors: DataFrame) -> np.ndarray:
    """Mean vector of every label of (label, vector) rows, in the order of the labels."""
    units = F.sum(F.round(F.col("x") * UNITS).cast("decimal(38,0)"))
    rows = vectors.select("label", F.posexplode("vector").alias("dim", "x")).groupBy("label", "dim").agg(units.alias("s"), F.count(F.lit(1)).alias("n")).collect()
    labels = sorted({r["label"] for r in rows})
    out = np.zeros((len(labels), 1 + max(r["dim"] for r in rows)))
    for r in rows:
        out[labels.index(r["label"]), r["dim"]] = round(int(r["s"]) / UNITS / r["n"], 9)
    return out


def _coin(key: str, salt: int):
    return F.xxhash64(key, F.lit(salt)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def seeds(vectors: DataFrame, k: int, seed: int = 42) -> np.ndarray:
    """``k`` starting centres: rounds in which every row is drawn with a chance that grows with its distance from the centres so far, then a weighted choice among
    the drawn rows. The coins are hashes of the keys, so equal tables give equal seeds."""
    first = vectors.orderBy(F.xxhash64("key", F.lit(seed)), "key").select("vector").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    found = np.array([first[0]["vector"]], np.float64)
    for r in range(SEED_ROUNDS):
        near = assigned(vectors, found)
        cost = near.agg(F.sum("distance")).first()[0]
        if not cost:
            break
        drawn = near.filter(_coin("key", seed + 1 + r) < F.lit(OVERSAMPLE * k / cost) * F.col("distance")).select("key")
        rows = vectors.join(drawn, "key").select("key", "vector").collect()  # some OVERSAMPLE * k rows
        if rows:
            found = np.vstack([found, [r_["vector"] for r_ in sorted(rows, key=lambda r_: r_["key"])]])
    found = np.unique(found, axis=0)
    weight = np.zeros(len(found))
    for r in assigned(vectors, found).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect():
        weight[r["cluster"]] = r["n"]
    rng, chosen = np.random.default_rng(seed), [int(weight.argmax())]
    while len(chosen) < min(k, len(found)):
        chance = weight * distances(found, found[chosen]).min(1)
        if not chance.sum():
            break
        chosen.append(int(rng.choice(len(found), p=chance / chance.sum())))
    return found[chosen]


def unit_vectors(vectors: DataFrame, key: str, col: str) -> DataFrame:
    return l2_normalize(vectors.select(key, col), key, col).select(F.col(key).cast("long").alias("key"), F.col(col).alias("vector"))


def cluster_vectors(vectors: DataFrame, k: int, key: str = "vec_id", col: str = "embedding", seed: int = 42, rounds: int = ROUNDS) -> DataFrame:
    """K-means clusters of the unit vectors: ``key`` and cluster of every row. The same table gives the same clusters, however it is laid out."""
    rows = unit_vectors(vectors, key, col)
    centers = seeds(rows, k, seed)
    if not len(centers):
        return vectors.select(key, F.lit(0).alias("cluster"))
    return assigned(rows, lloyd(rows, centers, rounds)).select(F.col("key").alias(key), "cluster")


def needed_probes(asked: DataFrame, corpus: DataFrame, filed: DataFrame, centers: np.ndarray, k: int, seed: int = 42) -> int:
    """How many of its nearest cells a query must ask for ``TRIAL_RECALL`` of its exact neighbours, as ``TRIAL_QUERIES`` queries drawn by a hash show.

    ``asked`` and ``corpus`` are unit vectors (key, vector), ``filed`` has the cluster of every key of ``corpus``. What comes back is bounded by the drawn queries.
    """
    drawn = asked.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(TRIAL_QUERIES)
    rows = drawn.collect()
    trial = asked.sparkSession.createDataFrame([(r["key"], r["vector"]) for r in rows], "query_id LONG, vector ARRAY<DOUBLE>")
    near = topk_similar(trial, corpus.select(F.col("key").alias("vec_id"), "vector"), k).select("query_id", F.col("vec_id").alias("key"))
    found = filed.join(F.broadcast(near), "key").select("query_id", "cluster").collect()
    if not found:
        return min(PROBES, len(centers))
    order = np.argsort(distances(np.array([r["vector"] for r in rows], np.float64), centers), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centers)), order.shape), 1)
    row = {r["key"]: i for i, r in enumerate(rows)}
    ranks = np.sort([place[row[r["query_id"]], r["cluster"]] for r in found])
    return min(len(centers), max(PROBES, 1 + int(ranks[int(np.ceil(TRIAL_RECALL * len(ranks))) - 1])))


def ivf_search(queries: DataFrame, corpus: DataFrame, k: int, cells: int | None = None, probes: int | None = None, seed: int = 42) -> DataFrame:
    """The ``k`` most similar corpus vectors for each query, looked for in the ``probes`` nearest cells of an inverted file; scores are exact.

    Without ``probes`` as many cells are asked as a trial on a bounded number of queries finds to be needed (``needed_probes``): vectors without clusters need most.
    ``queries`` has (query_id, vector), ``corpus`` has (vec_id, vector). Cells are learned from at most ``TRAIN_ROWS`` vectors and hold all. Vectors and the queries
    that ask for their cell meet in one shuffle; a cell of more than ``HELD_ROWS`` vectors is cut in parts that each of its queries visits. So the work grows with
    the queries, and neither queries nor vectors come to the driver.
    """
    unit = lambda df, key: unit_vectors(df.select(key, "vector"), key, "vector")
    c, q = unit(corpus, "vec_id"), unit(queries, "query_id")
    n = c.count()
    if not n:
        return queries.select(F.col("query_id").cast("long"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    cells = cells or int(min(MOST_CELLS, max(1, round(n ** 0.5))))
    centers = lloyd(*(lambda s: (s, seeds(s, cells, seed)))(c.filter(_coin("key", seed) < F.lit(TRAIN_ROWS / n)) if n > TRAIN_ROWS else c), 10)
    filed = c.join(assigned(c, centers).select("key", "cluster"), "key")
    parts = assigned(c, centers).groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / HELD_ROWS).cast("int").alias("parts"))  # one row for each cell
    probes = probes or needed_probes(q, c, assigned(c, centers).select("key", "cluster"), centers, k, seed)
    asked = q.join(assigned(q, centers, min(probes, len(centers))).select("key", "cluster"), "key")
    held = filed.join(F.broadcast(parts), "cluster").select("cluster", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "key", "vector")
    asks = asked.join(F.broadcast(parts), "cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "key", "vector")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, [], []
        for batch in batches:
            cell = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            kind, key, x = batch.column(2).to_numpy(), batch.column(3).to_numpy(), matrix(batch.column(4))
            cut = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1]))))
            for a, b in zip(cut, [*cut[1:], len(cell)]):
                if cell[a] != now:
                    now, ids, rows = cell[a], [], []
                if kind[a] == 0:
                    ids.append(key[a:b])
                    rows.append(x[a:b])
                elif ids:
                    vec, some = np.concatenate(ids), np.vstack(rows)
                    ids, rows = [vec], [some]
                    for s in blocks(b - a, len(vec)):
                        part, who = x[a:b][s], key[a:b][s]
                        scores = np.round(part @ some.T, 9)
                        order = np.lexsort((np.broadcast_to(vec, scores.shape), -scores), axis=1)[:, :k]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who, order.shape[1])), pa.array(vec[order].ravel()),
                                                          pa.array(np.take_along_axis(scores, order, 1).ravel())], names=["query_id", "vec_id", "score"])

    both = held.unionByName(asks).repartition("cluster", "part").sortWithinPartitions("cluster", "part", "kind")
    found = both.mapInArrow(scan, "query_id LONG, vec_id LONG, score DOUBLE")
    return top_k(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
