"""Mixing to target weights with soft domain membership.

A classifier trained on a labelled table gives every document a posterior over domains. Rates for the documents are then fitted by projected gradient
descent on weighted least squares, so that the expected tokens of each domain, sum of rate * tokens * posterior, meet the targets. Starting from rate 1, a step is
``r <- clip(r - p . y)``: ``p`` is the document's posterior and ``y`` (one number for each domain) follows from the totals of the step before. So a step is one
aggregate over a slim table, the rate of a document is an expression of its posterior, and documents that look alike get like rates whatever their length.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import toxicity
from textloom.llm.common import TEXT_ROWS, stored

#: Most gradient steps, and the share of all tokens that the totals may miss before the steps end. Targets within reach need about ten steps. Those out of reach
#: keep the steps going, which are longer then: at the end the weighted squares are within a quarter of the least.
STEPS, CLOSE, LONG = 40, 1e-6, 1.9

DOMAINS, TARGETS = ("low", "high"), (0.2, 0.8)
#: Highest rate: no document is repeated more often than this, whatever the targets ask for.
MOST = 8.0


def posteriors(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], key: str, text: str) -> DataFrame:
    """``docs`` with ``p``: one posterior for each domain, summing to 1. ``labelled`` has (key, domain).

    One model for each domain against all others (for two domains one model does for both), fitted on a bounded sample of the labelled rows.
    """
    known = toxicity.sampled(labelled.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("domain").alias("domain"), F.max("domain").alias("_most"))
                             .filter("domain = _most").drop("_most"), key=key)
    sample = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(known.withColumnRenamed(key, "key")), "key")
    out = docs
    for k, name in list(enumerate(domains))[1 if len(domains) == 2 else 0:]:
        model = toxicity.fit(sample.withColumn("label", (F.col("domain") == name).cast("int")))
        out = toxicity.score(out, model, text, tuple(out.columns), f"_p{k}")
    if len(domains) == 2:
        out = out.withColumn("_p0", 1 - F.col("_p1"))
    raw = [F.col(f"_p{k}") + F.lit(1e-9) for k in range(len(domains))]
    total = reduce(Column.__add__, raw)
    return out.withColumn("p", F.array(*[c / total for c in raw])).drop(*[f"_p{k}" for k in range(len(domains))])


def fitted_rates(table: DataFrame, targets: tuple[float, ...], grow: bool, most: float = MOST) -> tuple[Column, np.ndarray, np.ndarray]:
    """(rate expression over ``p``, fitted totals, wanted totals) for a stored ``table`` of (tokens, p).

    Rates lie between 1 and ``most`` with ``grow``, and the targets are shares of whatever the total grows to; else they lie between 0 and ``most`` and the total is
    to stay as it is. What the totals miss is weighed by the inverse Gram matrix of the posteriors, in which the best step without bounds has length 1, and
    every step below 2 leads to the minimum.
    """
    d = len(targets)
    share = np.array(targets) / sum(targets)
    p = [F.col("p")[k] for k in range(d)]
    # With ``grow`` a token of posterior p moves the totals off their shares by p - share, and nothing is to be left of that.
    moves = [c - F.lit(float(v)) for c, v in zip(p, share)] if grow else p
    plain = table.agg(*[F.coalesce(F.sum(F.col("tokens") * c), F.lit(0.0)) for c in p],
                      *[F.coalesce(F.sum(F.col("tokens") * a * b), F.lit(0.0)) for a in moves for b in moves]).first()
    have, weight = np.array(plain[:d]), np.linalg.pinv(np.array(plain[d:]).reshape(d, d), rcond=1e-9, hermitian=True)
    rate, total, want = F.lit(1.0), have, share * have.sum()
    for k in range(STEPS):
        if np.abs(total - want).sum() <= CLOSE * max(have.sum(), 1.0):
            break
        y = weight @ (total - want) * (LONG if k > 10 else 1.0)
        step = rate - reduce(Column.__add__, [c * F.lit(float(v)) for c, v in zip(moves, y)])
        rate = F.least(F.lit(most), F.greatest(F.lit(1.0 if grow else 0.0), step))
        total = np.array(table.agg(*[F.coalesce(F.sum(F.col("tokens") * rate * c), F.lit(0.0)) for c in p]).first())
        want = share * total.sum() if grow else want
    return rate, total, want


def mixed(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = DOMAINS, targets: tuple[float, ...] = TARGETS, grow: bool = True,
          key: str = "doc_id", text: str = "text") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(rates, fitted totals, wanted totals). Rates: every row of ``docs`` as key, text_hash, tokens, p, rate and copies.

    ``copies`` is the rate rounded up or down by a coin from the hash of key and text, so that its expectation is the rate. With ``grow`` no rate is below 1:
    documents are repeated, none is dropped, and the total grows. Without it the total is to stay as it is, and documents may go.

    Tokens are runs of other characters than white space; null and empty texts have none and posteriors of the bias. A domain that no document
    belongs to, or one whose documents would have to be repeated more than ``MOST`` times, cannot reach its target: the totals returned show by how much.
    Repeated rows get equal rates; an empty table gives no rows; further columns are not read, whatever their names.
    """
    if len(domains) != len(targets) or min(targets) < 0 or sum(targets) <= 0:
        raise ValueError("one nonnegative target for each domain, not all 0")
    rows = docs.select(F.col(key), F.col(text), F.xxhash64(text).alias("text_hash"),
                       F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0d]+")), F.lit(0)).cast("double").alias("tokens"))
    table = stored(posteriors(rows, labelled, domains, key, text).select(key, "text_hash", "tokens", "p"), "posteriors", TEXT_ROWS)
    rate, total, want = fitted_rates(table, targets, grow)
    coin = F.xxhash64(F.lit(17), key, "text_hash").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    rated = table.withColumn("rate", rate)
    return rated.withColumn("copies", F.floor(F.col("rate") + coin).cast("int")), total, want


def repeated(docs: DataFrame, rates: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as its ``copies`` say (equal rows have equal copies)."""
    of = rates.groupBy(F.col(key).alias("id"), F.col("text_hash").alias("hash")).agg(F.max("copies").alias("copies"))
    row = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"), F.struct("*").alias("row")).alias("r")
    of = of.alias("o")
    both = row.join(of, F.col("r.id").eqNullSafe(F.col("o.id")) & (F.col("r.hash") == F.col("o.hash"))).filter("o.copies > 0")
    return both.select("r.row", F.explode(F.sequence(F.lit(1), F.col("o.copies"))).alias("n")).select("row.*")


def quality_domains(labels: DataFrame) -> DataFrame:
    return labels.filter("quality IN (0, 1)").select("doc_id", F.when(F.col("quality") == 1, "high").otherwise("low").alias("domain"))
