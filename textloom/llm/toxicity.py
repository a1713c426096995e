"""Toxicity scores: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

* Features of a text: its words, neighbouring pairs, and pairs with one word between, each hashed to a slot. A feature counts once
  however often it stands in the text. No vocabulary is kept.
* Training: a bounded sample of the labelled rows (``SAMPLE_ROWS``, ``SAMPLE_BYTES`` of features; all rows below that) is turned to features by all tasks and
  written once. One task then reads it and runs FTRL-proximal over it, ``ROUNDS`` times in another order. Every row moves the common state, so a feature
  weighs the same wherever its rows stand, and none is left out for being rare: the L1 term alone keeps uninformative ones at exactly zero.
* Scoring: the weights that are left, at most one for each slot, are broadcast and every text is scored inside the scan: no shuffle of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import LOWER, TEXT_ROWS, batches_of, chunks, joined, mix64, prefix_hash, span_hash, stored, words

#: Slots: one half for single words, one for pairs. Proves the bound of the broadcast weights.
SLOT_BITS = 21
#: Labelled rows that training reads at most, chosen by a hash of the id, and bytes of their features; documented bounds of the sample.
SAMPLE_ROWS, SAMPLE_BYTES = 24_000, 192 << 20
#: Passes over the sample, and the rates of FTRL-proximal.
ROUNDS = 10
ALPHA, BETA, L1, L2 = 4.0, 1.0, 5.0, 0.0

#: Letters and digits of ASCII and every byte of a longer UTF-8 sequence.
IS_WORD = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of every feature of every text, in text order, repeats included."""
    data, offsets = joined(texts)
    data = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
    start, end = words(data, IS_WORD)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    one = span_hash(prefix_hash(data), start, end)
    owner = (np.searchsorted(offsets, start, "right") - 1).astype(np.int32)
    shift, half = np.uint64(64 - SLOT_BITS + 1), np.int64(1 << (SLOT_BITS - 1))
    parts = [(owner, (one >> shift).astype(np.int64))]
    for gap, salt in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        pair = mix64(one[:-gap] * np.uint64(salt) + one[gap:]) if len(one) > gap else one[:0]
        same = owner[:-gap] == owner[gap:] if len(one) > gap else np.zeros(0, bool)
        parts.append((owner[:-gap][same] if len(one) > gap else owner[:0], (pair[same] >> shift).astype(np.int64) + half))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int32)


def distinct_slots(owner: np.ndarray, slot: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct slots of each of ``n`` texts."""
    pairs = np.unique(owner.astype(np.int64) << 32 | slot)
    cut = np.searchsorted(pairs, np.arange(n + 1, dtype=np.int64) << 32)
    slots = (pairs & 0xFFFFFFFF).astype(np.int32)
    return [slots[a:b] for a, b in zip(cut, cut[1:])]


def solve(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the FTRL-proximal state: exactly zero wherever |z| stays within the L1 term."""
    return -(np.sign(z) * np.maximum(np.abs(z) - L1, 0)) / ((BETA + np.sqrt(n)) / ALPHA + L2)


class Model(NamedTuple):
    """Sparse weights and bias. A plain tuple of arrays, so that workers need not know this class to receive it."""
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | bytes | None]) -> np.ndarray:
        return scores_of(dense(self.slots, self.weights), self.bias, texts)


def dense(slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << SLOT_BITS, np.float32)
    out[slots] = weights
    return out


def scores_of(weights: np.ndarray, bias: float, texts: list[str | bytes | None]) -> np.ndarray:
    """Probability of label 1 for each text, from the weights of all slots."""
    out = np.empty(len(texts))
    for part in chunks(texts):
        some = texts[part]
        owner, slot = features(some)
        used = weights[slot] != 0  # few are left, so that only these are made distinct
        pairs = np.unique(owner[used].astype(np.int64) << 32 | slot[used])
        margin = np.bincount(pairs >> 32, weights[pairs & 0xFFFFFFFF], minlength=len(some)) + bias
        out[part] = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
    return out


def ftrl_pass(rows: list[np.ndarray], y: np.ndarray, z: np.ndarray, n: np.ndarray, bias: np.ndarray) -> None:
    """One pass of FTRL-proximal over the rows, in place. ``bias`` is (z, n) of an unpenalised constant feature."""
    for slots, target in zip(rows, y):
        z0, n0 = z[slots], n[slots]
        w, root = solve(z0, n0), np.sqrt(n0)
        b = -bias[0] / ((BETA + np.sqrt(bias[1])) / ALPHA)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -40, 40))) - target
        z[slots] = z0 + g - (np.sqrt(n0 + g * g) - root) / ALPHA * w
        n[slots] = n0 + g * g
        bias += (g - (np.sqrt(bias[1] + g * g) - np.sqrt(bias[1])) / ALPHA * b, g * g)


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "key") -> Model:
    """Train on (key, text, label 0/1) rows. Rows without a label are left out; a null text has no features.

    Without any row the score is 0.5 for every text; with one class only it is a constant near that class.
    """
    rows = labelled.filter(F.col(label).isin(0, 1)).select(
        F.xxhash64(key, F.lit(5)).alias("turn"), F.col(label).cast("double").alias("y"), F.col(text).cast("binary").alias("text"))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for part in chunks(texts):
                found = [s.tobytes() for s in distinct_slots(*features(texts[part]), part.stop - part.start)]
                some = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(found, pa.binary())], names=["turn", "y", "slots"])

    found = stored(rows.mapInArrow(featurize, "turn LONG, y DOUBLE, slots BINARY"), "toxic-features", TEXT_ROWS)
    positive, total, size = found.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("slots")), F.lit(0))).first()
    if total == 0 or positive in (0, total):
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log((positive + 1) / (total - positive + 1))))
    if size > SAMPLE_BYTES:
        found = found.filter(coin("turn", 29) < F.lit(SAMPLE_BYTES / size))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, y, slots = [], [], []
        for batch in batches:  # one array for all features of a batch, and views of it for the rows
            found = batch.column(2).cast(pa.large_binary())
            ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset:found.offset + len(found) + 1]
            flat = np.frombuffer(found.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(np.int32).copy()
            slots += np.split(flat, (ends[1:-1] - ends[0]) // 4)
            turn.append(batch.column(0).to_numpy())
            y.append(batch.column(1).to_numpy())
        y = np.concatenate(y)
        by = np.lexsort((y, np.concatenate(turn)))
        slots, y = [slots[k] for k in by], y[by]
        z, n, bias = np.zeros(1 << SLOT_BITS), np.zeros(1 << SLOT_BITS), np.zeros(2)
        for k in range(ROUNDS):
            order = np.random.default_rng(k).permutation(len(y))
            ftrl_pass([slots[i] for i in order], y[order], z, n, bias)
        at = np.flatnonzero(np.abs(z) > L1).astype(np.int32)
        w = solve(z[at], n[at]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()]), pa.array([w.tobytes()]), pa.array([-bias[0] / ((BETA + np.sqrt(bias[1])) / ALPHA)])],
                                         names=["slots", "weights", "bias"])

    # One task on purpose: the sample is bounded, and FTRL goes through it row by row.
    with batches_of(labelled.sparkSession, TEXT_ROWS):
        slots, weights, bias = found.coalesce(1).mapInArrow(train, "slots BINARY, weights BINARY, bias DOUBLE").first()
    return Model(np.frombuffer(bytes(slots), np.int32), np.frombuffer(bytes(weights), np.float32), bias)


def coin(key: str, salt: int):
    """A number from 0 to 1 from the hash of a column."""
    return F.xxhash64(key, F.lit(salt)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def score(docs: DataFrame, model: Model, text: str = "text", columns: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``columns`` of every row and its score as ``name``: 0 to 1, higher where label 1 is likelier. A null text scores as the empty one.

    Where ``columns`` hold the texts, store the result by ``TEXT_ROWS``: they go through Python and back."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))  # bounded by the slots
    wanted = [*columns, *([] if text in columns else [text])]
    at, n, names = wanted.index(text), len(columns), [*columns, name]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, bias = sent.value
        every = dense(slots, weights)
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            for part in chunks(texts):
                some = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*some.columns[:n], pa.array(scores_of(every, bias, texts[part]))], names=names)

    fields = [T.StructField(c, docs.schema[c].dataType) for c in columns] + [T.StructField(name, T.DoubleType())]
    return docs.select(*wanted).mapInArrow(scored, T.StructType(fields))


def sampled(labels: DataFrame, rows: int = SAMPLE_ROWS, key: str = "doc_id") -> DataFrame:
    """About ``rows`` of the labelled rows, by a hash of the key; all of them if there are no more."""
    share = rows / max(labels.count(), 1)
    return labels if share >= 1 else labels.filter(coin(key, 13) < F.lit(share))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """Fit on the labelled documents outside the held-out fold (crc32 of the id as text, modulo 5, is 0).

    A null id has no label. A document with several equal label rows is learned once, with contradicting labels not at all.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(
        F.min(label).alias("label"), F.max(label).alias("_most")).filter(F.col("label") == F.col("_most")).select(key, "label")
    known = sampled(known, key=key)
    rows = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(known), key)  # at most SAMPLE_ROWS
    return fit(rows.select(F.col(key).alias("key"), "text", "label"))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score, predicted (1 where score >= 0.5) of every document.

    Repeated rows are scored each; a null key is never held out; empty and null texts get the score of the bias. An empty table gives no rows; further columns
    are not read, whatever their names.
    """
    got = score(docs, learn(docs, labels, key=key, text=text), text, (key,))
    return got.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
