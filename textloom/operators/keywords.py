"""Keyword extraction: relative frequency, and single-document statistical scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators.lexical import lemma_counts
from textloom.scale import cluster_by, top_k

TOP_KEYWORDS = 20
MIN_TERM_LENGTH = 3


def keywords_frequency(toks: DataFrame, k: int = TOP_KEYWORDS) -> DataFrame:
    """Share of each content lemma in its document; ties alphabetical."""
    counts = lemma_counts(toks)
    total = F.sum("count").over(Window.partitionBy("doc_id"))
    scored = counts.select("doc_id", F.col("lemma").alias("keyword"), "count", total.alias("_total"))
    best = top_k(scored, ["doc_id"], [F.desc("count"), F.asc("keyword")], k)
    return best.withColumn("score", F.col("count") / F.col("_total")).drop("_total")


def sentence_words(docs: DataFrame) -> DataFrame:
    """One row for each sentence of documents: the document's number of ``sentences``, ``sent_id``, and ``words``, an array of (text, lower, inner, is_stop).

    The text is shuffled once by document; everything that follows is laid out by it.
    """
    rows = cluster_by(docs.select("doc_id", "lang", "text"), "doc_id")
    rows = rows.select("doc_id", "lang", tx.raw_sentences(F.col("text")).alias("_s")).select(
        "doc_id", "lang", F.size("_s").alias("sentences"), F.posexplode("_s").alias("sent_id", "_t"))
    toks = F.transform(F.regexp_extract_all("_t", F.lit(tx.TOKEN), F.lit(0)), lambda t, i: F.struct(t.alias("text"), (i > 0).alias("inner")))
    words = F.filter(toks, lambda t: F.substring(t["text"], 1, 1).rlike(r"\p{L}"))
    rows = rows.select("doc_id", "lang", "sentences", "sent_id", words.alias("_w"))
    return rows.select("doc_id", "sentences", "sent_id", F.transform("_w", lambda w: F.struct(
        w["text"].alias("text"), F.lower(w["text"]).alias("lower"), w["inner"].alias("inner"),
        tx.is_stop(F.col("lang"), F.lower(w["text"])).alias("is_stop"))).alias("words"))


def sentence_words_of_tokens(toks: DataFrame) -> DataFrame:
    """The same for a token table, with its own stop flags."""
    words = F.array_sort(F.collect_list(F.struct("tok_id", "text", "lower", (F.col("sent_pos") > 0).alias("inner"), "is_stop", "is_alpha")))
    rows = toks.groupBy("doc_id", "sent_id").agg(words.alias("_w"))
    rows = rows.withColumn("sentences", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    return rows.select("doc_id", "sentences", "sent_id", F.filter("_w", lambda w: w["is_alpha"]).alias("words"))


def term_statistics(words: DataFrame) -> DataFrame:
    """Per (document, term): casing, position, frequency, dispersion of neighbours and sentence spread. Neighbours are elements of the sentence's array."""
    def with_neighbours(w: Column, i: Column) -> Column:
        return F.struct(w["lower"].alias("term"), w["text"].alias("text"), w["inner"].alias("inner"), w["is_stop"].alias("is_stop"),
                        F.get("words", i - 1)["lower"].alias("left"), F.get("words", i + 1)["lower"].alias("right"))

    rows = words.select("doc_id", "sentences", "sent_id", F.transform("words", with_neighbours).alias("_w"))
    rows = rows.select("doc_id", "sentences", "sent_id", F.inline(F.filter("_w", lambda w: ~w["is_stop"] & (F.length(w["term"]) >= MIN_TERM_LENGTH))))
    acronym = (F.upper("text") == F.col("text")) & (F.lower("text") != F.col("text"))
    head = F.substring("text", 1, 1)
    capital = (F.upper(head) == head) & (F.lower(head) != head) & F.col("inner")
    # The lists hold the surroundings of one term in one document. Sets and a median would each keep a hash table for every term.
    terms = rows.groupBy("doc_id", "sentences", "term").agg(
        F.count(F.lit(1)).alias("tf"), F.count_if(acronym).alias("tf_acronym"), F.count_if(capital).alias("tf_capital"),
        F.array_sort(F.collect_list("sent_id")).alias("_at"), F.collect_list("left").alias("_l"), F.collect_list("right").alias("_r"))
    middle = (F.get("_at", ((F.col("tf") - 1) / 2).cast("int")) + F.get("_at", (F.col("tf") / 2).cast("int"))) / 2
    distinct = lambda c: F.size(F.array_distinct(c))
    return terms.select("doc_id", "sentences", "term", "tf", "tf_acronym", "tf_capital", middle.alias("median_sentence"), distinct("_at").alias("term_sentences"),
                        distinct("_l").alias("left_distinct"), F.size("_l").alias("left_n"), distinct("_r").alias("right_distinct"), F.size("_r").alias("right_n"))


def keywords_yake(words: DataFrame, k: int = TOP_KEYWORDS) -> DataFrame:
    """Single-word keywords by the published statistical scheme; the reported score is inverted (high is better).

    ``words``: ``sentence_words`` of documents or of tokens. Case = max(acronym, capital) / (1 + ln tf);
    position = ln(ln(3 + median sentence)); norm = tf / (mean tf + sd tf); relatedness =
    1 + (left + right dispersion) * tf / max tf; spread = share of sentences with the term;
    S = rel * pos / (case + norm / rel + spread / rel); keyword score = S / (tf * (1 + S)).
    """
    whole = Window.partitionBy("doc_id")
    tf = F.col("tf").cast("double")
    stats = term_statistics(words).withColumn("_sum", F.sum("tf").over(whole)).withColumn(
        "_sumsq", F.sum(F.col("tf") * F.col("tf")).over(whole)).withColumn(
        "_n", F.count(F.lit(1)).over(whole)).withColumn("_max", F.max("tf").over(whole))
    mean = F.col("_sum") / F.col("_n")
    variance = F.col("_sumsq") / F.col("_n") - mean * mean
    sd = F.sqrt(F.greatest(F.lit(0.0), variance))
    dispersion = (F.coalesce(F.try_divide("left_distinct", "left_n"), F.lit(0.0))
                  + F.coalesce(F.try_divide("right_distinct", "right_n"), F.lit(0.0)))
    rows = stats.select(
        "doc_id", "term", "tf",
        (F.greatest("tf_acronym", "tf_capital") / (1.0 + F.log(tf))).alias("t_case"),
        F.log(F.log(3.0 + F.col("median_sentence"))).alias("t_pos"),
        (tf / (mean + sd)).alias("t_norm"),
        (1.0 + dispersion * tf / F.col("_max")).alias("t_rel"),
        (F.col("term_sentences") / F.col("sentences")).alias("t_spread"))
    s = (F.col("t_rel") * F.col("t_pos")
         / (F.col("t_case") + F.col("t_norm") / F.col("t_rel") + F.col("t_spread") / F.col("t_rel")))
    rows = rows.withColumn("_s", s)
    raw = F.col("_s") / (F.col("tf") * (1.0 + F.col("_s")))
    rows = rows.select("doc_id", F.col("term").alias("keyword"), raw.alias("_raw"))
    rows = rows.withColumn("score", F.round(F.when(F.col("_raw") > 0, 1.0 / F.col("_raw")).otherwise(0.0), 6))
    return top_k(rows.drop("_raw"), ["doc_id"], [F.desc("score"), F.asc("keyword")], k)
