"""Analyzer registry, result rows and payloads."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import __version__, lexicons
from textloom.operators import embeddings, keywords, language, lexical, profile, readability, sentiment, tokens, trees
from textloom.operators.registry import Registry

OPTIONAL = ("embeddings", "sentiment")


class Corpus:
    """Documents (``doc_id``, ``text``, ``lang``, ``lang_confidence``) with the relations analyzers share.

    The relations are lazy; Spark reuses the single shuffle of the text where plans coincide.
    """

    def __init__(self, docs: DataFrame, lexicon: DataFrame | None = None, valence: DataFrame | None = None,
                 backend: embeddings.EmbeddingBackend | None = None):
        self.docs = docs
        self.lexicon = lexicon
        self.valence = valence
        self.backend = backend or embeddings.get_backend("hashed-words")

    @cached_property
    def tokens(self) -> DataFrame:
        return tokens.tokens(self.docs, self.lexicon)

    @cached_property
    def arcs(self) -> DataFrame:
        return trees.baseline_arcs(self.tokens)

    @cached_property
    def sentences(self) -> DataFrame:
        """Sentences with arcs; those of the default lexicon need no token table."""
        return trees.document_sentences(self.docs) if self.lexicon is None else trees.laid_out_baseline(trees.gathered(self.tokens))

    @cached_property
    def profiles(self) -> DataFrame:
        """The figures of the built-in analyzers from few passes over the text (``profile``)."""
        keep = tuple(c for c in ("lang", "lang_confidence") if c in self.docs.columns)
        return profile.profiles(self.docs, self.lexicon, self.valence, keep=keep)

    @cached_property
    def spans(self) -> DataFrame:
        return tokens.entities(self.docs)


Analyzer = Callable[[Corpus], DataFrame]
_ANALYZERS = Registry("analyzer")
#: Decorator for ``fn(corpus) -> DataFrame(doc_id, confidence, results STRUCT)``.
register_analyzer = _ANALYZERS.adding
available_analyzers = _ANALYZERS.names
get_analyzer = _ANALYZERS.find


def select_analyzers(enable: list[str] | None = None, disable: list[str] | None = None,
                     with_embeddings: bool = False, with_sentiment: bool = False) -> list[str]:
    """Names to run: the enabled (default: all) without the disabled and the unknown. The two optional analyzers run with their flag, even where they are
    disabled, and without it never, even where they are enabled. ``dependency`` always runs. ``chosen_analyzers`` is the same rule over columns.
    """
    known = available_analyzers()
    chosen = [n for n in dict.fromkeys(enable or known) if n in known and n not in (disable or ())]
    for name, wanted in zip(OPTIONAL, (with_embeddings, with_sentiment)):
        chosen = [n for n in chosen if n != name] if not wanted else chosen if name in chosen else [*chosen, name]
    return chosen if "dependency" in chosen else [*chosen, "dependency"]


def chosen_analyzers(enable: Column, disable: Column, with_embeddings: Column, with_sentiment: Column) -> Column:
    """The rule of ``select_analyzers`` for every row: arrays of names and flags in, array of names out. Null or empty ``enable`` means all."""
    known = F.array(*[F.lit(n) for n in available_analyzers()])
    chosen = F.when(F.coalesce(F.size(enable), F.lit(0)) > 0, F.array_distinct(enable)).otherwise(known)
    chosen = F.filter(chosen, lambda n: F.array_contains(known, n) & ~F.coalesce(F.array_contains(disable, n), F.lit(False)))
    for name, wanted in zip(OPTIONAL, (with_embeddings, with_sentiment)):
        rest = F.array_remove(chosen, F.lit(name))
        chosen = F.when(wanted, F.when(F.array_contains(chosen, name), chosen).otherwise(F.array_append(chosen, F.lit(name)))).otherwise(rest)
    return F.when(F.array_contains(chosen, "dependency"), chosen).otherwise(F.array_append(chosen, F.lit("dependency")))


def _ranked(rows: DataFrame, by: list[str], order: str, a: str, b: str, name: str) -> DataFrame:
    """Ranked pairs of each group as a JSON array text."""
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, a, b))).alias("_p")).select(
        *by, F.transform("_p", lambda s: F.array(s[a].cast("variant"), s[b].cast("variant"))).alias(name))


def _as_map(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(name))


def _results(rows: DataFrame, confidence: Column | float = 1.0) -> DataFrame:
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return rows.select("doc_id", conf.cast("double").alias("confidence"),
                       F.struct(*[c for c in rows.columns if c != "doc_id"]).alias("results"))


@register_analyzer("lexical_stats")
def _lexical(c: Corpus) -> DataFrame:
    top = _ranked(lexical.top_lemmas(c.tokens), ["doc_id"], "rank", "lemma", "count", "top_lemmas")
    rows = lexical.lexical_stats(c.docs).join(top, "doc_id", "left")
    return _results(rows.withColumn("top_lemmas", F.coalesce("top_lemmas", F.array().cast("array<array<variant>>"))))


@register_analyzer("pos")
def _pos(c: Corpus) -> DataFrame:
    counts = lexical.upos_counts(c.tokens)
    rows = counts.groupBy("doc_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("upos", "count")))).alias("upos_counts"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("upos", "ratio")))).alias("upos_ratios"))
    top = lexical.top_lemmas_by_upos(c.tokens)
    top = top.groupBy("doc_id", "upos").agg(F.sort_array(F.collect_list(F.struct("rank", "lemma", "count"))).alias("_p"))
    top = top.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("upos", "_p")))).alias("_m"))
    top = top.select("doc_id", F.transform_values("_m", lambda k, v: F.transform(
        v, lambda s: F.array(s["lemma"].cast("variant"), s["count"].cast("variant")))).alias("top_lemmas_by_upos"))
    rows = c.docs.select("doc_id").join(rows, "doc_id", "left").join(top, "doc_id", "left")
    return _results(rows.select(
        "doc_id", F.coalesce("upos_counts", F.create_map().cast("map<string,bigint>")).alias("upos_counts"),
        F.coalesce("upos_ratios", F.create_map().cast("map<string,double>")).alias("upos_ratios"),
        F.coalesce("top_lemmas_by_upos", F.create_map().cast("map<string,array<array<variant>>>")).alias("top_lemmas_by_upos")))


@register_analyzer("ner")
def _ner(c: Corpus) -> DataFrame:
    spans = c.spans
    counts = _as_map(lexical.ner_counts(spans), "label", "count", "counts_by_label")
    examples = lexical.ner_examples(spans).groupBy("doc_id", "label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]).alias("texts"))
    examples = _as_map(examples, "label", "texts", "examples_by_label")
    rows = lexical.ner_summary(c.docs, spans).join(counts, "doc_id", "left").join(examples, "doc_id", "left")
    return _results(rows.select(
        "doc_id", "supported", F.coalesce("counts_by_label", F.create_map().cast("map<string,bigint>")).alias("counts_by_label"),
        F.coalesce("examples_by_label", F.create_map().cast("map<string,array<string>>")).alias("examples_by_label"),
        "total_entities"))


@register_analyzer("readability")
def _readability(c: Corpus) -> DataFrame:
    rows = readability.text_standard(readability.scores(c.docs)).drop("consensus_grade", "words", "syllables")
    return _results(rows.select("doc_id", F.lit(True).alias("supported"), F.lit(profile.READABILITY_NOTE).alias("note"),
                                *[x for x in rows.columns if x != "doc_id"]))


@register_analyzer("keywords")
def _keywords(c: Corpus) -> DataFrame:
    rows = keywords.keywords_yake(keywords.sentence_words(c.docs) if c.lexicon is None else keywords.sentence_words_of_tokens(c.tokens))
    packed = _ranked(rows, ["doc_id"], "rank", "keyword", "score", "keywords")
    out = c.docs.select("doc_id").join(packed, "doc_id", "left")
    return _results(out.select("doc_id", F.lit("yake").alias("method"),
                               F.coalesce("keywords", F.array().cast("array<array<variant>>")).alias("keywords")))


@register_analyzer("dependency")
def _dependency(c: Corpus) -> DataFrame:
    deps = _as_map(lexical.dep_counts(trees.exploded(c.sentences, "doc_id")), "dep", "count", "dep_counts")
    arcs = lexical.head_pos_dep(c.sentences)
    pairs = _as_map(arcs, "arc", "count", "head_pos_dep")
    rows = c.docs.select("doc_id").join(deps, "doc_id", "left").join(pairs, "doc_id", "left")
    rows = rows.join(c.docs.select("doc_id", "lang"), "doc_id")
    has = F.col("dep_counts").isNotNull() & (F.col("lang").isin(*lexicons.LANGUAGE_MODELS) if c.lexicon is None else F.lit(True))
    return _results(rows.select(
        "doc_id", has.alias("supported"), F.when(~has, profile.NO_PARSER).alias("note"), F.when(has, F.col("dep_counts")).alias("dep_counts"),
        F.when(has, F.coalesce("head_pos_dep", F.create_map().cast("map<string,bigint>"))).alias("head_pos_dep")),
        F.when(F.col("supported"), 0.9).otherwise(0.8))


@register_analyzer("sentiment")
def _sentiment(c: Corpus) -> DataFrame:
    valence = c.valence
    if valence is None:
        valence = sentiment.valence_table(c.docs.sparkSession, lexicons.VALENCE)
    rows = sentiment.valence_scores(c.docs, valence)
    return _results(rows.select(
        "doc_id", F.lit(True).alias("supported"), sentiment.label(F.col("compound")).alias("label"),
        F.abs("compound").alias("score"), F.lit("valence").alias("method"),
        F.struct("neg", "neu", "pos", "compound").alias("scores")), F.col("score"))


@register_analyzer("embeddings")
def _embeddings(c: Corpus) -> DataFrame:
    rows = embeddings.embed_documents(c.docs, c.backend)
    return _results(rows.select("doc_id", F.lit(True).alias("supported"), "backend", "model", "dim", "normalized", "vector"))


_BUILT_IN = dict(_ANALYZERS.entries)
#: Analyzers whose results are columns of ``Corpus.profiles``, with the confidence of a result.
FUSED: dict[str, Callable[[], Column]] = {n: lambda: F.lit(1.0) for n in ("lexical_stats", "pos", "ner", "readability", "keywords", "embeddings")}
FUSED["sentiment"] = lambda: F.col("sentiment.score")
FUSED["dependency"] = lambda: F.when(F.col("dependency.supported"), 0.9).otherwise(0.8)


def _is_fused(corpus: Corpus, name: str) -> bool:
    """Own analyzers, and embeddings by another back end, have a pass of their own."""
    return name in FUSED and _ANALYZERS.entries[name] is _BUILT_IN[name] and (name != "embeddings" or isinstance(corpus.backend, embeddings.HashedWords))


def _wide_results(corpus: Corpus, names: list[str]) -> DataFrame:
    """One row for each document: doc_id, lang, lang_confidence, model, and for each analyzer a struct (confidence, results)."""
    if not names:
        raise ValueError("no analyzer selected")
    fused = [n for n in names if _is_fused(corpus, n)]
    if fused:
        base = corpus.profiles
        keep = [c for c in ("lang", "lang_confidence") if c in base.columns]
        rows = base.select("doc_id", *keep, *[F.struct(FUSED[n]().cast("double").alias("confidence"), F.col(n).alias("results")).alias(n) for n in fused])
    else:
        rows = corpus.docs.select("doc_id", *[c for c in ("lang", "lang_confidence") if c in corpus.docs.columns])
    for n in names:
        if n not in fused:
            own = get_analyzer(n)(corpus)
            rows = rows.join(own.select("doc_id", F.struct("confidence", "results").alias(n)), "doc_id", "left")
    rows = rows.withColumnRenamed("lang", "language_code")
    return language.route_language(rows, F.col("language_code")).drop("language", "error")


def analyzer_results(corpus: Corpus, names: list[str]) -> DataFrame:
    """One row per (document, analyzer): name, confidence, results as JSON text, language and model. ``processing_time`` is null: steps of one plan have no time
    of their own."""
    rows = _wide_results(corpus, names)
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}.confidence").alias("confidence"), F.lit(None).cast("double").alias("processing_time"),
                                 F.to_json(f"{n}.results").alias("results")) for n in names])
    meta = [c for c in ("language_code", "lang_confidence", "model") if c in rows.columns]
    return rows.select("doc_id", *meta, F.inline(entries)).filter("results IS NOT NULL").select("doc_id", "name", "confidence", "processing_time", "results", *meta)


#: Result values that are kept in the flat summary, per analyzer.
SCALAR_TYPES = ("string", "long", "integer", "double", "boolean")


def analyzer_summary(corpus: Corpus, names: list[str]) -> DataFrame:
    """Flat summary: one row per (document, analyzer), scalar results only, the union of all result columns."""
    rows = _wide_results(corpus, names)
    scalars = {n: [f.name for f in rows.schema[n].dataType["results"].dataType.fields if f.dataType.typeName() in SCALAR_TYPES] for n in names}
    kinds = {f: rows.schema[n].dataType["results"].dataType[f].dataType for n in names for f in scalars[n]}
    value = lambda n, f: (F.col(f"{n}.results.{f}") if f in scalars[n] else F.lit(None)).cast(kinds[f]).alias(f"results_{f}")
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}.confidence").alias("confidence"), F.lit(None).cast("double").alias("processing_time"),
                                 *[value(n, f) for f in kinds]) for n in names])
    return rows.select("doc_id", F.col("language_code").alias("metadata_language"), F.col("model").alias("metadata_model"), F.inline(entries)).filter("confidence IS NOT NULL")


def payloads(corpus: Corpus, content: DataFrame, names: list[str], tool: str = "textloom") -> DataFrame:
    """One JSON payload per document, built in its row.

    ``content``: doc_id, source_type, source_value, domain, title, char_count, word_count.
    """
    body = _wide_results(corpus, names).join(content, "doc_id")
    conf = F.col("lang_confidence") if "lang_confidence" in body.columns else F.lit(None).cast("double")
    meta = F.struct(F.struct(F.col("language_code").alias("code"), conf.alias("confidence")).alias("language"), F.col("model"))
    entries = F.array(*[F.when(F.col(n).isNotNull(), F.struct(
        F.lit(n).alias("name"), F.lit(0.0).alias("processing_time"), F.col(f"{n}.confidence").alias("confidence"),
        F.parse_json(F.to_json(f"{n}.results")).alias("results"), meta.alias("metadata"))) for n in sorted(names)])
    return body.select("doc_id", F.col("language_code").alias("language"), F.to_json(F.struct(
        F.lit(tool).alias("tool"), F.lit(__version__).alias("version"),
        F.struct(F.col("source_type").alias("type"), F.col("source_value").alias("value"), F.col("domain")).alias("source"),
        F.struct(F.col("language_code").alias("code"), conf.alias("confidence"), F.col("model")).alias("language"),
        F.struct("title", "char_count", "word_count").alias("content"), F.filter(entries, lambda e: e.isNotNull()).alias("analyzers"))).alias("payload"))


def token_json(docs: DataFrame, arcs: DataFrame, spans: DataFrame) -> DataFrame:
    """Token-level JSON per document: text, tokens with ten attributes and their sentence, entity spans.

    Tokens are gathered by document, as they were in its text, and get their entity and their place in the text as elements of that row; the token table is not
    shuffled again.
    """
    before = Window.partitionBy("doc_id").orderBy("tok_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = arcs.withColumn("_before", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int"))
    token = F.struct("tok_id", "text", "lemma", "upos", "xpos", "dep", "head_id", "ws", "_before", "sent_id")
    toks = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(token)).alias("_t"))
    ents = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("ents"))
    lead = F.length("text") - F.length(F.regexp_replace("text", r"^\s+", ""))
    joined = docs.select("doc_id", "text", lead.alias("_lead")).join(toks, "doc_id", "left").join(ents, "doc_id", "left")
    joined = joined.withColumn("ents", F.coalesce("ents", F.array().cast(ents.schema["ents"].dataType)))
    joined = joined.withColumn("_t", F.coalesce("_t", F.array().cast(toks.schema["_t"].dataType)))
    inside = F.flatten(F.transform("ents", lambda e: F.transform(F.sequence(e["start"], e["end"] - 1), lambda i: F.struct(i.alias("i"), e["label"].alias("label")))))
    joined = joined.withColumn("_e", F.map_from_entries(inside))
    listed = F.transform("_t", lambda t: F.struct(
        t["tok_id"].alias("id"), t["text"].alias("text"), t["lemma"].alias("lemma"), t["upos"].alias("pos"), t["xpos"].alias("tag"), t["dep"].alias("dep"),
        t["head_id"].alias("head"), F.coalesce(F.try_element_at("_e", t["tok_id"]), F.lit("")).alias("ent_type"), t["ws"].alias("whitespace"),
        (t["_before"] + F.col("_lead")).alias("idx"), t["sent_id"].alias("sent")))
    return joined.select("doc_id", F.to_json(F.struct("text", listed.alias("tokens"), "ents")).alias("json"))
