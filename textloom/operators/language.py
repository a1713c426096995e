"""Language identification by character profiles, precedence and routing. Detection is map-only.

A profile holds a log weight for every slot that a trigram of letters can fall into. Texts are read in lower case, with one blank for everything that is no letter
and one sign for all letters of other scripts than Latin. Weights are whole thousandths, so that the sums do not depend on their order.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import lexicons
from textloom.functions import text as tx
from textloom.samples import LANGUAGE_SAMPLES
from textloom.scale import local_table

# Task functions of this module travel with the job, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHORT_TEXT = 200
LOW_CONFIDENCE = 0.6
UNSUPPORTED_CONFIDENCE = 0.6
#: Slots of a profile, what every slot counts beforehand, and the trigrams whose evidence is taken for independent.
SLOTS, PRIOR, EVIDENCE = 4093, 0.3, 50
#: Multipliers of the three code points of a trigram.
MIX = (1_000_003, 10_007, 101)
#: Characters of texts that are scored at once.
HELD_CHARACTERS = 1_000_000

Profiles = dict[str, list[int]]


def letters(text: Column) -> Column:
    """Text as profiles read it, with a blank before and behind."""
    latin = F.regexp_replace(F.lower(text), r"[^\p{IsLatin}\P{L}]", "#")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(latin, r"[^\p{L}#]+", " ")), F.lit(" "))


def trigram_slots(text: Column) -> Column:
    """Slot of every trigram of a text that went through ``letters``."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    triples = F.arrays_zip(codes.alias("a"), F.slice(codes, F.lit(2), F.length(text)).alias("b"), F.slice(codes, F.lit(3), F.length(text)).alias("c"))
    mixed = F.transform(triples, lambda t: (t["a"] * MIX[0] + t["b"] * MIX[1] + t["c"] * MIX[2]) % SLOTS)
    return F.filter(mixed, lambda s: s.isNotNull())


def learn_profiles(samples: DataFrame) -> Profiles:
    """Log weights of every language of (lang, text) rows, learned by one aggregate over their trigrams. What comes back is bounded by languages and slots."""
    slots = samples.select("lang", F.explode(trigram_slots(letters(F.col("text")))).alias("slot"))
    counts = slots.groupBy("lang", "slot").agg(F.count(F.lit(1)).alias("n"))
    out: dict[str, dict[int, int]] = {}
    for r in counts.collect():
        out.setdefault(r["lang"], {})[r["slot"]] = r["n"]
    profiles = {}
    for lang, seen in sorted(out.items()):
        total = sum(seen.values()) + PRIOR * SLOTS
        profiles[lang] = [round(1000 * math.log((seen.get(s, 0) + PRIOR) / total)) for s in range(SLOTS)]
    return profiles


def default_samples() -> list[tuple[str, str]]:
    """(lang, text): the sample texts, with the function words of the languages that have them."""
    return [(lang, " ".join([text, *lexicons.stop_words(lang)])) for lang, text in sorted(LANGUAGE_SAMPLES.items())]


_DEFAULT: Profiles = {}


def default_profiles(docs: DataFrame) -> Profiles:
    """Profiles of the sample texts, learned once in a process."""
    if not _DEFAULT:
        _DEFAULT.update(learn_profiles(local_table(docs.sparkSession, default_samples(), "lang STRING, text STRING")))
    return _DEFAULT


def scorer(profiles: Profiles) -> Callable[[pa.Array], pa.Array]:
    """Function of a batch of texts that went through ``letters``: for each text the sum of every profile (in the order of their names) over its trigrams, and
    their number. The slots are those of ``trigram_slots``."""
    weights = np.array([profiles[name] for name in sorted(profiles)], np.int64)
    slots, mix, held = SLOTS, MIX, HELD_CHARACTERS

    def sums(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(t) for t in texts])
        n = np.maximum(np.diff(ends, prepend=0) - 2, 0)
        slot = (codes[:-2] * mix[0] + codes[1:-1] * mix[1] + codes[2:] * mix[2]) % slots
        starts = np.concatenate(([0], ends[:-1]))
        out = np.zeros((len(texts), len(weights)), np.int64)
        for i, w in enumerate(weights):
            total = np.concatenate(([0], np.cumsum(w[slot])))
            out[:, i] = np.where(n > 0, total[np.minimum(starts + n, len(slot))] - total[np.minimum(starts, len(slot))], 0)
        return out, n

    def score(column: pa.Array) -> pa.Array:
        texts, parts, at, size = column.to_pylist(), [], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= held or i + 1 == len(texts):  # few texts at once, however long they are
                parts.append(sums(texts[at:i + 1]))
                at, size = i + 1, 0
        total = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, len(weights)), np.int64)
        n = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(weights))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(total.ravel())), pa.array(n.astype(np.int32))], names=["sums", "n"])

    return score


def detect_language(docs: DataFrame, profiles: Profiles | None = None, supported: tuple[str, ...] = tuple(sorted(lexicons.LANGUAGE_MODELS))) -> DataFrame:
    """Add ``language`` and ``language_confidence``.

    The language is the one whose profile gives the text's trigrams the greatest sum (ties: alphabetical). The confidence is its share when the sums
    are taken for log likelihoods, long texts counting as ``EVIDENCE`` trigrams. Then: texts under 200 characters have their confidence multiplied by 0.8; a language
    that is not ``supported`` becomes (en, at most 0.6); a text without letters is (en, 0.3), a blank one (en, 0.0).
    """
    profiles = profiles or default_profiles(docs)
    body = tx.strip(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumn("_len", F.length(body)).withColumn("_letters", letters(F.coalesce(F.col("text"), F.lit(""))))
    names = sorted(profiles)
    score = F.arrow_udf(scorer(profiles), "struct<sums:array<bigint>,n:int>")
    rows = rows.withColumn("_s", score("_letters")).withColumn("_none", F.trim("_letters") == "").drop("_letters")
    scores = F.array(*[F.struct(F.get("_s.sums", F.lit(i)).alias("n"), F.lit(-i).alias("order"), F.lit(lang).alias("lang")) for i, lang in enumerate(names)])
    rows = rows.withColumn("_scores", scores).withColumn("_scale", F.least(F.lit(1.0), EVIDENCE / F.greatest(F.lit(1), F.col("_s.n"))) / 1000).drop("_s")
    rows = rows.withColumn("_best", F.array_max("_scores"))
    mass = F.aggregate("_scores", F.lit(0.0), lambda total, s: total + F.exp((s["n"] - F.col("_best.n")) * F.col("_scale")))
    share = 1 / mass
    share = F.when(F.col("_len") < SHORT_TEXT, share * 0.8).otherwise(share)
    known = F.col("_best.lang").isin(*supported)
    language = F.when(F.col("_none") | ~known, "en").otherwise(F.col("_best.lang"))
    confidence = F.when(F.col("_len") == 0, 0.0).when(F.col("_none"), 0.3).when(known, share).otherwise(F.least(share, F.lit(UNSUPPORTED_CONFIDENCE)))
    # A generator of one row: a filter on the result stays above it, where it would otherwise be evaluated by scoring every text once more for each mention.
    return rows.select(*docs.columns, F.inline(F.array(F.struct(language.alias("language"), confidence.alias("language_confidence")))))


def resolve_language(detected: DataFrame, override: Column, default: Column) -> DataFrame:
    """Apply precedence: a non-blank override, then a non-blank default, then detection."""
    chosen = F.coalesce(F.nullif(tx.strip(override), F.lit("")), F.nullif(tx.strip(default), F.lit("")))
    return (detected
            .withColumn("language_confidence", F.when(chosen.isNotNull(), 1.0).otherwise(F.col("language_confidence")))
            .withColumn("language", F.when(chosen.isNotNull(), tx.normalize_lang(chosen)).otherwise(F.col("language"))))


def is_low_confidence(confidence: Column) -> Column:
    return confidence < LOW_CONFIDENCE


def route_language(df: DataFrame, code: Column) -> DataFrame:
    """Add the model for each row's language; rows of unsupported languages get a null model and an error."""
    spark = df.sparkSession
    dimension = local_table(spark, sorted(lexicons.LANGUAGE_MODELS.items()), "language STRING, model STRING")
    known = ", ".join(f"'{c}'" for c in sorted(lexicons.LANGUAGE_MODELS))
    routed = df.withColumn("language", tx.normalize_lang(code)).join(F.broadcast(dimension), "language", "left")
    note = F.concat(F.lit("no model for language '"), code, F.lit(f"'; there are models for {known}"))
    return routed.withColumn("error", F.when(F.col("model").isNull(), note))
