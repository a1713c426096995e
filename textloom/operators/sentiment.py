"""Rule-based sentiment over word sequences.

Order of the valence rules for every listed word: all-capitals emphasis (only in mixed-case texts), boosters
one to three words before (fading with distance), negators one to three words before, then the contrast rule.
Valences are summed as integers of a millionth, so the result does not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import lexicons
from textloom.functions import text as tx
from textloom.scale import bounded_broadcast, local_table

# Fixed values of the published valence rules.
CAPS_STEP = 0.733
NEGATION = -0.74
FADE = (1.0, 0.95, 0.9)
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5
BANG_STEP, MAX_BANGS = 0.292, 4
ALPHA = 15.0
LABEL_CUT = 0.05
POLARITY_CUT = 0.1
MICRO = 1_000_000


def valence_table(spark: SparkSession, entries: dict[str, float]) -> DataFrame:
    return local_table(spark, sorted(entries.items()), "word STRING, valence DOUBLE")


def scored_words(texts: DataFrame, valence: DataFrame, negators: tuple[str, ...] = lexicons.NEGATORS,
                 boosters: dict[str, float] = lexicons.BOOSTERS, contrast: tuple[str, ...] = lexicons.CONTRAST_WORDS,
                 extra: tuple[str, ...] = ()) -> DataFrame:
    """Words with their valence after every word-level rule (null for unlisted words), and the exclamation marks of their text; a text without words has
    one row without a word.

    What stands before a word is looked up by position in arrays of the row, so no text is shuffled or sorted. ``extra`` columns are kept.
    """
    mixed = F.col("text").rlike(r"\p{Ll}") & F.col("text").rlike(r"\p{Lu}")
    bangs = F.least(F.lit(MAX_BANGS), F.length("text") - F.length(F.replace("text", F.lit("!"))))
    rows = texts.select("doc_id", *extra, mixed.alias("_mixed"), bangs.alias("_bangs"), F.regexp_extract_all("text", F.lit(tx.WORD), F.lit(0)).alias("_w"))
    rows = rows.withColumn("_l", F.transform("_w", lambda w: F.lower(w)))
    rows = rows.withColumn("_b", F.transform("_l", lambda w: _booster(w, boosters))).withColumn("_n", F.transform("_l", lambda w: w.isin(*negators)))
    rows = rows.withColumn("_c", F.nullif(F.array_position(F.transform("_l", lambda w: w.isin(*contrast)), F.lit(True)), F.lit(0)) - 1)

    def before(name: str, i: Column, default: Column) -> list[Column]:
        return [F.coalesce(F.get(name, i - k), default) for k in (1, 2, 3)]

    def placed(w: Column, i: Column) -> Column:
        b, n = before("_b", i, F.lit(0.0)), before("_n", i, F.lit(False))
        return F.struct(i.alias("pos"), w.alias("word"), F.get("_l", i).alias("lower"), (b[0] * FADE[0] + b[1] * FADE[1] + b[2] * FADE[2]).alias("boost"),
                        (n[0] | n[1] | n[2]).alias("negated"))

    rows = rows.select("doc_id", *extra, "_mixed", "_bangs", F.col("_c").alias("first_contrast"), F.inline_outer(F.transform("_w", placed)))
    rows = rows.join(bounded_broadcast(valence).withColumnRenamed("word", "_listed"), F.col("lower") == F.col("_listed"), "left")
    v = F.col("valence")
    sign = F.when(v > 0, 1.0).when(v < 0, -1.0).otherwise(0.0)
    caps = (F.upper("word") == F.col("word")) & (F.length("word") > 1) & F.col("_mixed")
    v = v + F.when(caps, sign * CAPS_STEP).otherwise(0.0)
    v = v + sign * F.col("boost")
    v = F.when(F.col("negated"), v * NEGATION).otherwise(v)
    v = (F.when(F.col("first_contrast").isNull() | (F.col("pos") == F.col("first_contrast")), v)
         .when(F.col("pos") < F.col("first_contrast"), v * BEFORE_CONTRAST).otherwise(v * AFTER_CONTRAST))
    return rows.select("doc_id", *extra, "_bangs", "pos", "lower", F.round(v * MICRO).cast("long").alias("micro"))


def _booster(word: Column, boosters: dict[str, float]) -> Column:
    step = F.lit(0.0)
    for value in sorted(set(boosters.values())):
        step = F.when(word.isin(*[w for w, b in boosters.items() if b == value]), value).otherwise(step)
    return step


def valence_scores(texts: DataFrame, valence: DataFrame, extra: tuple[str, ...] = (), **lists) -> DataFrame:
    """neg, neu, pos shares and the compound score per text, and its ``extra`` columns. Texts without words are neutral.

    ``lists`` may replace the negators, boosters and contrast words of ``scored_words``.
    """
    words = scored_words(texts, valence, extra=extra, **lists)
    m = F.coalesce(F.col("micro"), F.lit(0))
    # Summed in the map task: a few numbers of each text are all that is shuffled.
    rows = words.groupBy("doc_id", *extra, "_bangs").agg(
        F.sum(m).alias("_sum"),
        F.sum(F.when(m > 0, m + MICRO).otherwise(0)).alias("_pos"),
        F.sum(F.when(m < 0, MICRO - m).otherwise(0)).alias("_neg"),
        (F.count_if((m == 0) & F.col("lower").isNotNull()) * MICRO).alias("_neu"))
    bang = F.round(F.col("_bangs") * BANG_STEP * MICRO).cast("long")
    total = (F.when(F.col("_sum") > 0, F.col("_sum") + bang).when(F.col("_sum") < 0, F.col("_sum") - bang)
             .otherwise(F.col("_sum")))
    rows = rows.withColumn("_x", total.cast("double") / MICRO)
    compound = F.col("_x") / F.sqrt(F.col("_x") * F.col("_x") + ALPHA)
    mass = (F.col("_pos") + F.col("_neg") + F.col("_neu")).cast("double")
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c).cast("double"), mass), F.lit(0.0)), 6)
    return rows.select("doc_id", *extra, share("_neg").alias("neg"), share("_neu").alias("neu"), share("_pos").alias("pos"),
                       F.round(compound, 6).alias("compound"))


def label(value: Column, cut: float = LABEL_CUT) -> Column:
    return F.when(value >= cut, "positive").when(value <= -cut, "negative").otherwise("neutral")


def sentiment_label(texts: DataFrame, valence: DataFrame) -> DataFrame:
    scores = valence_scores(texts, valence)
    return scores.select("doc_id", label(F.col("compound")).alias("label"), F.abs("compound").alias("score"))


def polarity_scores(texts: DataFrame, polarity: DataFrame) -> DataFrame:
    """Mean polarity and subjectivity of the listed words; strict thresholds of a tenth."""
    rows = texts.select("doc_id", F.explode_outer(tx.words(F.col("text"))).alias("lower"))
    rows = rows.join(bounded_broadcast(polarity), F.col("lower") == F.col("word"), "left")
    micro = lambda c: F.sum(F.round(F.col(c) * MICRO).cast("long"))
    sums = rows.groupBy("doc_id").agg(micro("polarity").alias("_p"), micro("subjectivity").alias("_s"),
                                      F.count("polarity").alias("_n"))
    mean = lambda c: F.round(F.coalesce(F.try_divide(F.col(c).cast("double") / MICRO, F.col("_n")), F.lit(0.0)), 6)
    out = sums.select("doc_id", mean("_p").alias("polarity"), mean("_s").alias("subjectivity"))
    cut = (F.when(F.col("polarity") > POLARITY_CUT, "positive").when(F.col("polarity") < -POLARITY_CUT, "negative")
           .otherwise("neutral"))
    return out.select("doc_id", "polarity", "subjectivity", cut.alias("label"), F.abs("polarity").alias("score"))


def sentiment_with_fallback(texts: DataFrame, valence: DataFrame | None, polarity: DataFrame | None) -> DataFrame:
    """Use the valence rules when a valence table is given, else the polarity table, else mark unsupported.

    The confidence of a result is its score, and 0 when unsupported.
    """
    if valence is not None:
        rows = sentiment_label(texts, valence).withColumn("method", F.lit("valence"))
    elif polarity is not None:
        rows = polarity_scores(texts, polarity).select("doc_id", "label", "score", F.lit("polarity").alias("method"))
    else:
        rows = texts.select("doc_id", F.lit(None).cast("string").alias("label"),
                            F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("method"))
    return rows.select("doc_id", F.col("method").isNotNull().alias("supported"), "label", "score", "method",
                       F.coalesce("score", F.lit(0.0)).alias("confidence"))
