"""Profile of a document: the figures of all analyzers from few passes over the text.

The text is shuffled once by document. Its sentences are arrays of the document's row, never rows of their own; entries of several kinds (tags, lemmas, relations,
arcs, cells, terms) are counted by array operations over batches of documents (``counts``), which return the few that analyzers list.
Scalar figures come from the same rows without any shuffle. Entity spans and valence have passes of their own, because their rows depend on look-up tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import lexicons
from textloom.functions import vectors as vx
from textloom.operators import counts, embeddings, keywords, lexical, readability, sentiment, tokens, trees
from textloom.scale import cluster_by

READABILITY_NOTE = "The formulas were fitted to English prose; compare scores of other languages with care."
NO_PARSER = "no arcs: the document has no tokens, or its language has no rules"


def scalars(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Lexical statistics and readability of documents, map-only."""
    read = readability.text_standard(readability.scores(rows, extra=(*keep, "text"))).drop("consensus_grade", "words", "syllables")
    kept = tuple(c for c in read.columns if c not in ("doc_id", "text"))
    return lexical.lexical_stats(read, extra=kept).select("doc_id", *keep, F.struct(*[
        "total_tokens", "unique_lemmas", "sentences", "avg_token_length", "avg_sentence_length_tokens", "type_token_ratio"]).alias("lexical"), F.struct(
            F.lit(True).alias("supported"), F.lit(READABILITY_NOTE).alias("note"), *[c for c in kept if c not in keep]).alias("readability"))


def pairs(ranked: Column, a: str, b) -> Column:
    """Array of [text, number] pairs."""
    return F.transform(ranked, lambda s: F.array(s[a].cast("variant"), b(s).cast("variant")))


def first_by_tag(tagged: Column) -> Column:
    tags = F.array_sort(F.array_distinct(F.transform(tagged, lambda t: t["upos"])))
    of_tag = lambda u: F.filter(tagged, lambda t: t["upos"] == u)
    return F.map_from_entries(F.transform(tags, lambda u: F.struct(u.alias("key"), pairs(of_tag(u), "lemma", lambda s: s["n"]).alias("value"))))


def scored_terms(terms: Column, k: int) -> Column:
    """The ``k`` best terms as [term, score] pairs."""
    rounded = F.transform(terms, lambda t: F.struct((-F.round(t["score"], 6)).alias("less"), t["term"].alias("term")))
    return pairs(F.slice(F.array_sort(rounded), 1, k), "term", lambda s: -s["less"])


def with_counts(rows: DataFrame, dim: int) -> DataFrame:
    """Add the counted entries (``counts``) of ``lang``, ``_sents`` (``trees.sentence_arrays``) and ``lexical.sentences``."""
    first = {"lemmas": lexical.TOP_LEMMAS, "tagged": lexical.TOP_LEMMAS_PER_TAG, "arcs": lexical.TOP_ARCS, "terms": keywords.TOP_KEYWORDS}
    stop = {code: set(lexicons.stop_words(code)) for code in lexicons.FUNCTION_WORDS}
    run = counts.counter(dim, keywords.MIN_TERM_LENGTH, first, stop, {(code, form): base for code, form, base in lexicons.lemma_pairs()})
    counted = rows.withColumn("_c", F.arrow_udf(run, counts.COUNTS)("lang", "_sents", "lexical.sentences")).drop("_sents")
    return counted.select(*[c for c in counted.columns if c != "_c"], "_c.*")


def profiles(docs: DataFrame, lexicon: DataFrame | None = None, valence: DataFrame | None = None, gazetteer: DataFrame | None = None, dim: int = 64,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, lang, the columns ``keep`` and one struct for each analyzer. What is not selected of it is not computed."""
    keep = ("lang", *(c for c in keep if c != "lang"))
    # All parts carry the same columns, so that Spark reads and shuffles them once.
    rows = cluster_by(docs.filter("doc_id IS NOT NULL").select("doc_id", "text", *keep), "doc_id")
    if lexicon is None:
        seen = rows.groupBy("doc_id", *keep).agg(F.collect_list("text").alias("_seen")).drop(*keep)
    else:
        sents = trees.gathered(tokens.tokens(docs, lexicon).join(docs.select("doc_id", *keep[1:]), "doc_id"), *keep)
        toks = F.transform("toks", lambda t: F.struct(*[t[c].alias(c) for c in ("text", "lower", "is_alpha", "is_stop", "lemma")]))
        seen = sents.groupBy("doc_id", *keep).agg(F.collect_list(F.struct("sent_id", toks.alias("toks"), "upos")).alias("_seen")).drop(*keep)
    scores = sentiment.valence_scores(rows, valence if valence is not None else sentiment.valence_table(docs.sparkSession, lexicons.VALENCE), extra=keep)
    spans = tokens.entities(docs, gazetteer)
    named = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.array_sort(F.collect_list(F.struct("label", "start", "text"))).alias("spans"))
    out = scalars(rows, keep).join(seen, "doc_id", "left").join(scores.select("doc_id", F.struct("neg", "neu", "pos", "compound").alias("valence")), "doc_id", "left")
    out = out.join(named, "doc_id", "left")
    # Texts are joined, not tokens: sentences are cut and counted in the finished row, so that no token is sorted or shuffled.
    out = out.withColumn("_sents", trees.sentence_arrays(F.col("_seen")) if lexicon is None else F.col("_seen")).drop("_seen")
    out = out.withColumn("_sents", F.coalesce("_sents", F.array().cast(out.schema["_sents"].dataType)))
    out = with_counts(out, dim)
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast(out.schema["spans"].dataType)))
    tokens_seen = F.aggregate("tags", F.lit(0).cast("long"), lambda acc, t: acc + t["n"])
    by_tag = F.map_from_entries(F.array_sort(F.transform("tags", lambda t: F.struct(t["upos"].alias("key"), t["n"].alias("value")))))
    labels = F.array_sort(F.array_distinct("spans.label"))
    of_label = lambda x: F.filter("spans", lambda s: s["label"] == x)
    known = F.col("lang").isin(*lexicons.LANGUAGE_MODELS) if lexicon is None else F.lit(True)
    supported = known & (F.size("deps") > 0)
    return out.select(
        "doc_id", *keep,
        F.struct("lexical.*", pairs(F.col("lemmas"), "lemma", lambda s: s["n"]).alias("top_lemmas")).alias("lexical_stats"),
        F.struct(by_tag.alias("upos_counts"), F.transform_values(by_tag, lambda k, n: n / tokens_seen).alias("upos_ratios"),
                 first_by_tag(F.col("tagged")).alias("top_lemmas_by_upos")).alias("pos"),
        F.struct((F.size("spans") > 0).alias("supported"),
                 F.map_from_entries(F.transform(labels, lambda x: F.struct(x.alias("key"), F.size(of_label(x)).cast("long").alias("value")))).alias("counts_by_label"),
                 F.map_from_entries(F.transform(labels, lambda x: F.struct(x.alias("key"), F.transform(
                     F.slice(of_label(x), 1, lexical.NER_EXAMPLES), lambda s: s["text"]).alias("value")))).alias("examples_by_label"),
                 F.size("spans").cast("long").alias("total_entities")).alias("ner"),
        "readability",
        F.struct(F.lit("yake").alias("method"), scored_terms(F.col("terms"), keywords.TOP_KEYWORDS).alias("keywords")).alias("keywords"),
        F.struct(F.lit(True).alias("supported"), sentiment.label(F.col("valence.compound")).alias("label"), F.abs("valence.compound").alias("score"),
                 F.lit("valence").alias("method"), F.col("valence").alias("scores")).alias("sentiment"),
        F.struct(supported.alias("supported"), F.when(~supported, NO_PARSER).alias("note"),
                 F.when(supported, F.map_from_entries(F.array_sort(F.transform("deps", lambda d: F.struct(d["dep"].alias("key"), d["n"].alias("value")))))).alias("dep_counts"),
                 F.when(supported, F.map_from_entries(F.array_sort(F.transform("arcs", lambda x: F.struct(x["arc"].alias("key"), x["n"].alias("value")))))).alias("head_pos_dep")).alias("dependency"),
        F.struct(F.lit(True).alias("supported"), *[F.lit(v).alias(k) for k, v in embeddings.HashedWords(dim).provenance().items()],
                 vx.unit(F.col("cells"), vx.norm(F.col("cells"))).alias("vector")).alias("embeddings"))
