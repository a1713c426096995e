"""Readability scores from counts held inside each row. Map-only.

Counts: W words, S sentences (at least 1), C letters, Y syllables, P words of three or more syllables.
Difficult words are the distinct words of two or more syllables that are not on the easy list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import lexicons
from textloom.functions import text as tx

LINSEAR_WORDS = 100


def counts(docs: DataFrame, easy_words: tuple[str, ...] = lexicons.EASY_WORDS, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per-document counts every formula below is built from; ``extra`` columns are carried along."""
    rows = docs.select("doc_id", *extra, tx.words(F.col("text")).alias("_words"),
                       F.size(tx.raw_sentences(F.col("text"))).alias("_sents"),
                       _sample(F.col("text")).alias("_sample"))
    rows = rows.select("doc_id", *extra, "_words", "_sents", F.transform("_words", tx.syllables).alias("_syl"),
                       F.transform(tx.words(F.col("_sample")), tx.syllables).alias("_sample_syl"),
                       F.size(tx.raw_sentences(F.col("_sample"))).alias("_sample_sents"))
    hard = F.filter("_words", lambda w: ~w.isin(*easy_words) & (tx.syllables(w) >= 2))
    return rows.select(
        "doc_id", *extra, F.size("_words").alias("words"), F.greatest(F.lit(1), F.col("_sents")).alias("sentences"),
        F.length(F.array_join("_words", "")).alias("letters"),
        F.aggregate("_syl", F.lit(0), lambda acc, s: acc + s).alias("syllables"),
        F.size(F.filter("_syl", lambda s: s >= 3)).alias("polysyllables"),
        F.size(F.array_distinct(hard)).alias("difficult"),
        F.size("_sample_syl").alias("sample_words"),
        F.size(F.filter("_sample_syl", lambda s: s >= 3)).alias("sample_hard"),
        F.greatest(F.lit(1), F.col("_sample_sents")).alias("sample_sentences"))


def _sample(text: Column) -> Column:
    """The first hundred words the Linsear Write formula is defined on."""
    visible = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.slice(visible, 1, LINSEAR_WORDS), " ")


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def scores(docs: DataFrame, easy_words: tuple[str, ...] = lexicons.EASY_WORDS, extra: tuple[str, ...] = ()) -> DataFrame:
    """All scores of a document; a document without words scores 0."""
    rows = counts(docs, easy_words, extra)
    wps, spw = _ratio("words", "sentences"), _ratio("syllables", "words")
    lpw, spw100 = _ratio("letters", "words"), _ratio("sentences", "words")
    hard_pct = _ratio("difficult", "words") * 100.0
    poly = _ratio("polysyllables", "sentences")
    linsear = F.try_divide(
        (F.col("sample_words") - F.col("sample_hard") + F.col("sample_hard") * 3).cast("double"),
        F.col("sample_sentences").cast("double"))
    linsear = F.when(linsear > 20, linsear / 2.0).otherwise(linsear / 2.0 - 1.0)
    dale = 0.1579 * hard_pct + 0.0496 * wps
    formulas = {
        "flesch_reading_ease": 206.835 - 1.015 * wps - 84.6 * spw,
        "flesch_kincaid_grade": 0.39 * wps + 11.8 * spw - 15.59,
        "smog_index": F.when(F.col("sentences") >= 3, 1.043 * F.sqrt(30.0 * poly) + 3.1291).otherwise(0.0),
        "automated_readability_index": 4.71 * lpw + 0.5 * wps - 21.43,
        "coleman_liau_index": 0.0588 * (lpw * 100.0) - 0.296 * (spw100 * 100.0) - 15.8,
        "linsear_write_formula": linsear,
        "dale_chall_readability_score": F.when(hard_pct > 5.0, dale + 3.6365).otherwise(dale),
    }
    has_words = F.col("words") > 0
    return rows.select(
        "doc_id", *extra, F.col("words").cast("long").alias("words"), F.col("syllables").cast("long").alias("syllables"),
        *[F.round(F.when(has_words, f).otherwise(0.0), 6).alias(name) for name, f in formulas.items()],
        F.col("difficult").cast("long").alias("difficult_words"))


def ease_grade(ease: Column) -> Column:
    """School grade that corresponds to a reading-ease score."""
    grade = F.when(ease >= 90, 5).when(ease >= 80, 6).when(ease >= 70, 7).when(ease >= 60, 8)
    return grade.when(ease >= 50, 10).when(ease >= 40, 11).when(ease >= 30, 12).otherwise(13)


def ordinal(n: Column) -> Column:
    suffix = (F.when(F.pmod(n, F.lit(100)).between(11, 13), "th").when(F.pmod(n, F.lit(10)) == 1, "st")
              .when(F.pmod(n, F.lit(10)) == 2, "nd").when(F.pmod(n, F.lit(10)) == 3, "rd").otherwise("th"))
    return F.concat(n.cast("string"), suffix)


def text_standard(scored: DataFrame) -> DataFrame:
    """Consensus grade: the most frequent of all floored and ceiled grades, the lowest one on ties."""
    graded = ["flesch_kincaid_grade", "smog_index", "automated_readability_index", "coleman_liau_index",
              "linsear_write_formula", "dale_chall_readability_score"]
    votes = F.array(ease_grade(F.col("flesch_reading_ease")).cast("long"),
                    *[f(F.col(g)).cast("long") for g in graded for f in (F.floor, F.ceil)])
    rows = scored.select("*", votes.alias("_votes"))
    tally = F.transform(F.array_distinct("_votes"), lambda g: F.struct(
        F.size(F.filter("_votes", lambda v: v == g)).alias("n"), (-g).alias("neg")))
    grade = -F.array_max(tally)["neg"]
    rows = rows.withColumn("consensus_grade", grade).drop("_votes")
    return rows.withColumn("text_standard", F.concat(
        ordinal(F.col("consensus_grade") - 1), F.lit(" and "), ordinal(F.col("consensus_grade")), F.lit(" grade")))
