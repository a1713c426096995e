"""The training-data pipeline: documents pass five stages, each written as Parquet and read again before the next.

All columns pass the first four stages, whatever their names. Null and empty texts have no features, shingles or tokens: they keep the score of the bias, link with
nothing, hold no benchmark passage, and stay. Rows with a null id are documents like others. Of repeated rows the join keeps the first; an empty table
gives an empty result. Texts of any length are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontamination, mixing, ngram_join, sharding, toxicity
from textloom.llm.common import TEXT_ROWS, free_name, stored, table

SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, stored already: all columns pass through Python, a bounded number of rows at once."""
    model, score = toxicity.learn(docs, table(spark, sf_dir, "labels")), free_name(docs, "score")
    return stored(toxicity.score(docs, model, columns=tuple(docs.columns), name=score).filter(F.col(score) < 0.5).select(*docs.columns), "toxicity", TEXT_ROWS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links: the one with the smallest id."""
    return ngram_join.representatives(docs)


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the expected tokens of the quality domains meet their targets. Rates are 1 or more: none is dropped."""
    rates, _, _ = mixing.mixed(docs, mixing.quality_domains(table(spark, sf_dir, "labels")))
    return mixing.repeated(docs, rates)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(docs, SHARDS)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("benchmark_decontamination", drop_benchmark_overlaps),
          ("mixing", mix_quality), ("sharding", shard)]

#: Learned scores are no SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = docs if stage is drop_toxic else stored(docs, name)
    return STAGES[-1][1](spark, docs, sf_dir)
