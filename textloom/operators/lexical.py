"""Lexical statistics, part-of-speech, dependency and entity profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators.tokens import content_tokens
from textloom.scale import top_k

TOP_LEMMAS = 20
TOP_LEMMAS_PER_TAG = 5
TOP_ARCS = 20
NER_EXAMPLES = 10


def lexical_stats(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Counts, averages and type-token ratio per document from the raw text.

    All figures come from arrays built inside the row with the default word lists, so the job is map-only.
    ``lexical_stats_of_tokens`` gives the same figures for an annotated token table. ``extra`` columns are kept.
    """
    rows = docs.select("doc_id", *extra, F.col("lang").alias("_lang"), tx.words(F.col("text")).alias("_words"),
                       F.size(tx.raw_sentences(F.col("text"))).alias("sentences"))
    rows = rows.select("doc_id", *extra, "_lang", "sentences", F.size("_words").alias("_alpha"),
                       F.filter("_words", lambda w: ~tx.is_stop(F.col("_lang"), w)).alias("_content"))
    rows = rows.select(
        "doc_id", *extra, "sentences", "_alpha", F.size("_content").alias("_n"),
        F.length(F.array_join("_content", "")).alias("_chars"),
        F.size(F.array_distinct(F.transform("_content", lambda w: tx.lemma(F.col("_lang"), w)))).alias("_unique"), "_lang")
    return _stats(rows, extra)


def lexical_stats_of_tokens(toks: DataFrame) -> DataFrame:
    """The same figures for a token table; sentences without words count in the sentence average."""
    content = F.col("is_alpha") & ~F.col("is_stop")
    rows = toks.groupBy("doc_id").agg(
        F.countDistinct("sent_id").alias("sentences"),
        F.countDistinct(F.when(content, F.col("lemma"))).alias("_unique"),
        F.count_if("is_alpha").alias("_alpha"), F.count_if(content).alias("_n"),
        F.coalesce(F.sum(F.when(content, F.length("text"))), F.lit(0)).alias("_chars"))
    return _stats(rows)


def _stats(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    n, sents = F.col("_n"), F.col("sentences")
    return rows.select(
        "doc_id", *extra, n.cast("long").alias("total_tokens"), F.col("_unique").cast("long").alias("unique_lemmas"),
        sents.cast("long").alias("sentences"),
        F.coalesce(F.try_divide("_chars", n), F.lit(0.0)).alias("avg_token_length"),
        F.coalesce(F.try_divide("_alpha", sents), F.lit(0.0)).alias("avg_sentence_length_tokens"),
        F.coalesce(F.try_divide("_unique", n), F.lit(0.0)).alias("type_token_ratio"))


def lemma_counts(toks: DataFrame) -> DataFrame:
    return content_tokens(toks).groupBy("doc_id", "lemma").agg(F.count(F.lit(1)).alias("count"))


def top_lemmas(toks: DataFrame, k: int = TOP_LEMMAS) -> DataFrame:
    """Most frequent lemmas per document; ties in alphabetical order."""
    return top_k(lemma_counts(toks), ["doc_id"], [F.desc("count"), F.asc("lemma")], k)


def upos_counts(toks: DataFrame) -> DataFrame:
    """Tokens per tag, over all tokens, with their share of the document."""
    counts = toks.groupBy("doc_id", "upos").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy("doc_id"))
    return counts.withColumn("ratio", F.col("count") / total)


def top_lemmas_by_upos(toks: DataFrame, k: int = TOP_LEMMAS_PER_TAG) -> DataFrame:
    """Most frequent content lemmas per tag; ties in order of first occurrence, empty tags become X."""
    tag = F.when(F.coalesce(F.col("upos"), F.lit("")) == "", "X").otherwise(F.col("upos"))
    counts = (content_tokens(toks).groupBy("doc_id", tag.alias("upos"), "lemma")
              .agg(F.count(F.lit(1)).alias("count"), F.min("tok_id").alias("first_seen")))
    return top_k(counts, ["doc_id", "upos"], [F.desc("count"), F.asc("first_seen")], k)


def dep_counts(arcs: DataFrame) -> DataFrame:
    """Tokens per relation. Works on any rows with ``dep``; counted in the map task, so no text is shuffled."""
    return arcs.groupBy("doc_id", "dep").agg(F.count(F.lit(1)).alias("count"))


def head_pos_dep(sents: DataFrame, k: int = TOP_ARCS) -> DataFrame:
    """Most frequent ``head tag->label`` pairs per document; ties in order of first occurrence.

    ``sents`` are sentences with the arrays ``upos``, ``dep`` and ``head`` (``trees``): the head's tag is an element of the row.
    """
    arc = F.transform("dep", lambda d, i: F.struct(
        F.concat(F.get("upos", F.get("head", i)), F.lit("->"), d).alias("arc"), F.struct("sent_id", i.alias("i")).alias("at")))
    pairs = sents.select("doc_id", F.inline(arc)).filter("arc IS NOT NULL")
    counts = pairs.groupBy("doc_id", "arc").agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("first_seen"))
    return top_k(counts, ["doc_id"], [F.desc("count"), F.asc("first_seen")], k)


def ner_counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("count"))


def ner_summary(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Total entities per document; a document without entities is marked unsupported."""
    totals = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    joined = docs.select("doc_id").join(totals, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("total_entities"),
                         F.col("n").isNotNull().alias("supported"))


def ner_examples(spans: DataFrame, k: int = NER_EXAMPLES) -> DataFrame:
    """First entities of each label in document order, repeats kept."""
    return top_k(spans, ["doc_id", "label"], [F.asc("start")], k)


def corpus_rollup(docs: DataFrame, stats: DataFrame) -> DataFrame:
    """Totals of the per-document statistics by language and source, with subtotals."""
    joined = docs.select("doc_id", "lang", "source").join(stats, "doc_id")
    return joined.rollup("lang", "source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("total_tokens").alias("total_tokens"),
        F.sum("sentences").alias("sentences"))
