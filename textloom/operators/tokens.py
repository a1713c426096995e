"""Sentence, token, entity and arc relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import lexicons
from textloom.functions import text as tx
from textloom.scale import bounded_broadcast, cluster_by, local_table

#: First tokens of names that are tested in the row before they are looked up.
LISTED = 10_000

CONTENT_UPOS = ("NOUN", "PROPN", "VERB", "ADJ", "ADV", "NUM", "SYM")


def sentences(docs: DataFrame) -> DataFrame:
    """One row per sentence, numbered from 0. Map-only."""
    return docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sent_id", "sentence"))


def raw_tokens(docs: DataFrame) -> DataFrame:
    """One row per token in document order: sentence, position, text, following white space.

    The whole array is built inside the row and exploded once, so numbering needs no window.
    """
    pieces = F.flatten(F.transform(
        tx.raw_sentences(F.col("text")),
        lambda s, i: F.transform(
            F.regexp_extract_all(s, F.lit(tx.TOKEN_WITH_SPACE), F.lit(0)),
            lambda p, j: F.struct(i.alias("sent_id"), j.alias("sent_pos"), p.alias("piece")))))
    rows = docs.select("doc_id", "lang", F.posexplode(pieces).alias("tok_id", "p"))
    rows = rows.select("doc_id", "lang", F.col("p.sent_id").alias("sent_id"), F.col("p.sent_pos").alias("sent_pos"),
                       "tok_id", F.col("p.piece").alias("piece"),
                       F.rtrim(F.col("p.piece"), F.lit(tx.BLANKS)).alias("text"))
    return rows.select(
        "*", F.lower("text").alias("lower"),
        F.when(F.length("piece") > F.length("text"), " ").otherwise("").alias("ws"),
        tx.starts_with_letter(F.col("text")).alias("is_alpha"))


def upos_rule(lang: Column | str | None, lower: Column, text: Column, sent_pos: Column, is_alpha: Column) -> Column:
    """Part of speech of a token the lexicon does not list: shape first, then suffix, then NOUN. ``lang`` may be a column, a code, or None for a language without rules."""
    fixed = not isinstance(lang, Column)
    capital = tx.starts_with_capital(text) & (sent_pos > 0)
    word = F.when(capital, F.lit("NOUN" if lang == "de" else "PROPN") if fixed else F.when(lang == "de", "NOUN").otherwise("PROPN"))
    for code, upos, endings in lexicons.UPOS_SUFFIXES:
        if fixed and code != lang:
            continue
        test = F.lit(False)
        for ending in endings:
            test = test | F.endswith(lower, F.lit(ending))
        word = word.when(test if fixed else (lang == code) & test, upos)
    return (F.when(is_alpha, word.otherwise("NOUN"))
            .when(F.substring(text, 1, 1).rlike(r"\p{N}"), "NUM")
            .when(text.isin(*lexicons.PUNCTUATION), "PUNCT")
            .otherwise("SYM"))


def tokens(docs: DataFrame, lexicon: DataFrame | None = None, clustered: bool = True) -> DataFrame:
    """Annotated token table of documents (``doc_id``, ``lang``, ``text``).

    Stop flag, dictionary form and listed part of speech come from one join with the lexicon; unlisted words
    fall back to declared rules. With ``clustered`` the raw text is shuffled once by document, and every
    per-document group or window that follows runs without a further exchange.
    """
    if lexicon is None:
        lookup = F.broadcast(lexicons.lexicon(docs.sparkSession))  # a fixed list of a few hundred rows
    else:
        lookup = bounded_broadcast(lexicon)
    source = docs.select("doc_id", "lang", "text")
    rows = raw_tokens(cluster_by(source, "doc_id") if clustered else source)
    lookup = lookup.select(F.col("lang").alias("_lang"), F.col("word").alias("_word"), "is_stop",
                           F.col("lemma").alias("_lemma"), F.col("upos").alias("_upos"))
    rows = rows.join(lookup, (F.col("lang") == F.col("_lang")) & (F.col("lower") == F.col("_word")), "left")
    upos = F.coalesce(F.col("_upos"), upos_rule(F.col("lang"), F.col("lower"), F.col("text"),
                                                F.col("sent_pos"), F.col("is_alpha")))
    return rows.select(
        "doc_id", "lang", "sent_id", "sent_pos", "tok_id", "text", "lower", "ws", "piece", "is_alpha",
        F.coalesce("is_stop", F.lit(False)).alias("is_stop"), F.lit(False).alias("is_space"),
        F.lower(F.coalesce(F.nullif("_lemma", F.lit("")), F.col("text"))).alias("lemma"),
        upos.alias("upos"), *fine_tags(upos))


def fine_tags(upos: Column) -> tuple[Column, Column]:
    """``xpos`` and ``morph`` of a token with ``text`` and ``is_alpha``."""
    morph = (F.when(upos == "NUM", "NumType=Card").when(F.col("text") == ".", "PunctType=Peri").when(F.col("text") == ",", "PunctType=Comm")
             .when((upos == "PRON") & F.col("is_alpha"), "Case=Nom|PronType=Prs").otherwise(""))
    return F.when(upos == "PUNCT", F.col("text")).otherwise(upos).alias("xpos"), morph.alias("morph")


def content_tokens(toks: DataFrame) -> DataFrame:
    """Alphabetic tokens that are not stop words."""
    return toks.filter(F.col("is_alpha") & ~F.col("is_stop"))


def char_offsets(docs: DataFrame, toks: DataFrame) -> DataFrame:
    """Add ``char_idx``: characters before the token in the original text."""
    before = (Window.partitionBy("doc_id").orderBy("tok_id").rowsBetween(Window.unboundedPreceding, -1))
    lead = docs.select("doc_id", (F.length("text") - F.length(F.regexp_replace("text", r"^\s+", ""))).alias("_lead"))
    offsets = toks.withColumn("_before", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    return (offsets.join(lead, "doc_id")
            .withColumn("char_idx", (F.col("_before") + F.col("_lead")).cast("int")).drop("_before", "_lead"))


def name_table(gazetteer: DataFrame) -> DataFrame:
    """(key, first, n, label) of the names (name, name_label): key and first token as they are looked up, and the number of tokens."""
    pieces = F.regexp_extract_all(F.lower("name"), F.lit(tx.TOKEN_WITH_SPACE), F.lit(0))
    rows = gazetteer.select(pieces.alias("p"), F.col("name_label").alias("label")).filter(F.size("p") > 0)
    return rows.select(_phrase(F.col("p")).alias("key"), F.rtrim(F.col("p")[0], F.lit(tx.BLANKS)).alias("first"), F.size("p").alias("n"),
                       "label").groupBy("key", "first", "n").agg(F.min("label").alias("label"))


def _phrase(pieces: Column) -> Column:
    """Tokens with their white space as one text, runs of it as one blank."""
    return F.trim(F.regexp_replace(F.array_join(pieces, ""), r"\s+", " "))


def candidate_spans(docs: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Every place of a pattern (kind 0), of a name of the gazetteer in any case (1) and of a number (2): doc_id, start, end, label, text, kind.

    Patterns and numbers: the text is cut into chunks that are a pattern's or one word, and the start of a chunk is its number plus the extra tokens of
    earlier chunks. Names: each token is looked up in an index of first tokens, which tells the lengths of the names that start with it; only those are
    compared. Both come from one pass over the text, and only what may be an entity leaves the row. The index and the names are broadcast when they are
    proven small, else joined by a shuffle of the tokens.
    """
    names = name_table(gazetteer)
    lengths = names.groupBy("first").agg(F.collect_set("n").alias("lengths"))  # bounded by the longest name
    longest = names.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    branches = [p for _, p in lexicons.ENTITY_PATTERNS] + [lexicons.MIXED_WORD_PATTERN, lexicons.NUMBER_PATTERN, r"[^\s\p{L}\p{N}]"]
    rows = docs.select("doc_id", F.regexp_extract_all("text", F.lit("|".join(branches)), F.lit(0)).alias("_c"),
                       F.regexp_extract_all("text", F.lit(tx.TOKEN_WITH_SPACE), F.lit(0)).alias("_p"))
    chunks = F.filter(F.transform("_c", lambda c, i: F.struct(i.alias("i"), F.array(c).alias("w"), F.lit(False).alias("is_name"))),
                      lambda c: c["w"][0].rlike(r"[\p{N}@/]"))
    starts = F.transform("_p", lambda x, i: F.struct(i.alias("i"), F.lower(F.rtrim(x, F.lit(tx.BLANKS))).alias("first")))
    listed = [r[0] for r in lengths.select("first").limit(LISTED + 1).collect()]
    if len(listed) <= LISTED:  # a hashed set in the row keeps tokens that begin no name from leaving it; the look-ups below are the same without it
        starts = F.filter(starts, lambda t: t["first"].isin(*listed))
    starts = F.transform(starts, lambda t: F.struct(t["i"].alias("i"), F.slice("_p", t["i"] + 1, F.lit(longest)).alias("w"), F.lit(True).alias("is_name")))
    rows = rows.select("doc_id", F.inline(F.concat(chunks, starts)))
    # Chunks meet no name: their keys hold a line break, and the document's id, so that they are spread where the look-up is a shuffle.
    nowhere = F.concat(F.lit("\n"), F.col("doc_id").cast("string"))
    rows = rows.withColumn("_first", F.when(F.col("is_name"), F.lower(F.rtrim(F.col("w")[0], F.lit(tx.BLANKS)))).otherwise(nowhere))
    rows = rows.join(bounded_broadcast(lengths), F.col("_first") == F.col("first"), "left").filter(~F.col("is_name") | F.col("first").isNotNull())
    rows = rows.select("doc_id", "i", "w", "is_name", F.explode_outer("lengths").alias("_n")).filter(~F.col("is_name") | (F.size("w") >= F.col("_n")))
    rows = rows.withColumn("text", F.when(F.col("is_name"), _phrase(F.slice("w", F.lit(1), F.col("_n")))).otherwise(F.col("w")[0]))
    rows = rows.withColumn("_key", F.when(F.col("is_name"), F.lower("text")).otherwise(nowhere)).withColumn("_n", F.coalesce("_n", F.lit(0)))
    rows = rows.join(bounded_broadcast(names.withColumnRenamed("label", "name_label")), (F.col("_key") == F.col("key")) & (F.col("_n") == F.col("n")), "left")
    rows = rows.filter(~F.col("is_name") | F.col("key").isNotNull())
    rows = rows.withColumn("_size", F.when(F.col("is_name"), F.col("n")).otherwise(F.size(F.regexp_extract_all("text", F.lit(tx.TOKEN), F.lit(0)))))
    before = Window.partitionBy("doc_id", "is_name").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.when(F.col("is_name"), 0).otherwise(F.coalesce(F.sum(F.col("_size") - 1).over(before), F.lit(0)))
    rows = rows.withColumn("start", (F.col("i") + extra).cast("int"))
    label = F.lit(None).cast("string")
    for name, pattern in reversed(lexicons.ENTITY_PATTERNS):
        label = F.when(F.col("text").rlike(f"^(?:{pattern})$"), name).otherwise(label)
    label = F.coalesce(label, F.when(F.col("text").rlike(f"^{lexicons.NUMBER_PATTERN}$"), "CARDINAL"))
    rows = rows.withColumn("label", F.when(F.col("is_name"), F.col("name_label")).otherwise(label)).filter(F.col("label").isNotNull())
    kind = F.when(F.col("is_name"), 1).when(F.col("label") == "CARDINAL", 2).otherwise(0)
    return rows.select("doc_id", "start", (F.col("start") + F.col("_size")).cast("int").alias("end"), "label", "text", kind.alias("kind"))


def entities(docs: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Entity spans of documents: token offsets (half open), label and text.

    Patterns, names of the gazetteer and numbers are found independently; where they overlap, the one that starts first stays, of those that start
    together the pattern, then the longest name, then the number. Overlaps are settled in runs of touching spans, which are short however long the
    document is.
    """
    if gazetteer is None:
        gazetteer = local_table(docs.sparkSession, sorted(lexicons.GAZETTEER.items()), "name STRING, name_label STRING")
    spans = candidate_spans(docs, gazetteer)
    order = Window.partitionBy("doc_id").orderBy("start", "kind", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    spans = spans.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = spans.groupBy("doc_id", "_run").agg(F.array_sort(F.collect_list(F.struct("start", "kind", (-F.col("end")).alias("last"), "end", "label", "text"))).alias("s"))
    kept = F.aggregate("s", F.slice("s", 1, 0), lambda kept, x: F.when(
        (F.size(kept) == 0) | (x["start"] >= F.element_at(kept, -1)["end"]), F.concat(kept, F.array(x))).otherwise(kept))
    return runs.select("doc_id", F.inline(kept)).select("doc_id", "start", "end", "label", "text")
