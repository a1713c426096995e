"""Registered queries of the numbered operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontamination, fm_dedup, mixing, ngram_join, periodic_runs, sharding, spelling, suffix_dedup, token_counts, topk, toxicity, url_filters, warc
from textloom.llm.common import new_folder, table


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a cache of its own, so that every text of the table is a miss once."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), new_folder(spark, "token-cache"), path)


def op3_two_level_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), url_filters.rule_table(spark, url_filters.RULES))


def op5_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_token", "hits")


def op7_external_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op8_soft_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.quality_domains(table(spark, sf_dir, "labels"))
    rates, _, _ = mixing.mixed(table(spark, sf_dir, "documents"), labels)
    return rates.selectExpr("doc_id", "CAST(tokens AS BIGINT) AS n_tokens", "p[0] AS p_low", "p[1] AS p_high", "rate", "copies")


def op9_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op10_no_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op11_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.without_repeated_words(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), change=periodic_runs.planted)


def op13_trie_node_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), change=spelling.planted)


QUERIES = {f.__name__: f for f in (op1_sampled_splitters, op2_token_counts, op3_two_level_capture_index, op4_url_filters, op5_ftrl_toxicity, op6_spaced_seeds,
                                  op7_external_induced_sorting, op8_soft_membership,
                                  op9_grouped_prefix_join, op10_no_random_access, op11_fm_index,
                                  op12_periodic_runs, op13_trie_node_pairs)}
ORACLES: dict[str, str] = {"op4_url_filters": url_filters.JUDGE_SQL, "op10_no_random_access": topk.TOPK_SQL}
