"""CoNLL-U export of sentences with trees.

A sentence is one row with arrays (see ``trees``); its lines are built from that row, so documents are exported without a shuffle. The columns of the
uncorrected tree stay next to the repaired ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import tokens, trees

HEADER = ("# NOTE: heuristic conversion of parser labels; not guaranteed to be UD-valid",)
ENGINES = ("annotated", "baseline")
#: What the lines need of a token table; other columns are not gathered with it.
READ = ("doc_id", "sent_id", "tok_id", "text", "lemma", "upos", "xpos", "morph", "ws", "is_space", "dep", "head_id")


def conllu_tokens(arcs: DataFrame) -> DataFrame:
    """A token table with number, final head number and relation of every token; space tokens are dropped."""
    return trees.exploded(trees.laid_out_tree(trees.gathered(arcs, laid_out=True)), "doc_id", "sent_id")


def document_tokens(docs: DataFrame) -> DataFrame:
    """The same for documents with baseline arcs, map-only."""
    rows = trees.exploded(trees.with_tree(trees.document_sentences(docs)), "doc_id", "lang", "sent_id")
    return annotated(rows)


def annotated(rows: DataFrame) -> DataFrame:
    """The columns that ``tokens.tokens`` adds, for exploded sentences of documents."""
    return rows.select("*", F.when(F.col("spaced"), " ").otherwise("").alias("ws"), tx.lemma(F.col("lang"), F.col("lower")).alias("lemma"),
                       *tokens.fine_tags(F.col("upos")))


def token_line(rows: DataFrame) -> Column:
    """The ten columns of a token line."""
    misc = F.when(F.coalesce(F.col("ws"), F.lit("")) == "", "SpaceAfter=No").otherwise("_")
    return F.concat_ws(
        "\t", F.col("idx").cast("string"), tx.conllu_field(F.col("text")), tx.conllu_field(F.col("lemma")), F.col("upos"),
        F.col("xpos"), tx.conllu_feats(F.col("morph")), F.col("head_idx").cast("string"), F.col("deprel"), F.lit("_"), misc)


def conllu_lines(sents: DataFrame) -> DataFrame:
    """Lines of the export as rows (doc_id, sent_id, line_no, line): number comment, text comment, token lines, empty line.

    ``sents``: ``toks``, ``upos`` and ``tree`` of every sentence, and its text. The row is exploded once, with an empty entry for every line
    that is not a token's; what a token of a document lacks (lemma, fine tag, features) is added behind.
    """
    entry = F.arrays_zip(F.col("toks").alias("t"), "upos", F.col("tree.head_idx").alias("head_idx"), F.col("tree.deprel").alias("deprel"))
    rows = sents.withColumn("_e", entry)
    none = F.lit(None).cast(rows.schema["_e"].dataType.elementType)
    keys = [c for c in ("lang",) if c in sents.columns]
    rows = rows.select("doc_id", "sent_id", "sentence", *keys, F.posexplode(F.concat(F.array(none, none), "_e", F.array(none))).alias("line_no", "_x"))
    rows = rows.select("doc_id", "sent_id", "sentence", *keys, "line_no", F.col("_x").isNotNull().alias("_is_token"), (F.col("line_no") - 1).alias("idx"),
                       "_x.t.*", "_x.upos", "_x.head_idx", "_x.deprel")
    if "lemma" not in rows.columns:
        rows = annotated(rows)
    line = (F.when(F.col("_is_token"), token_line(rows)).when(F.col("line_no") == 0, F.concat(F.lit("# sent_id = "), F.col("sent_id").cast("string")))
            .when(F.col("line_no") == 1, F.concat(F.lit("# text = "), tx.conllu_field(F.col("sentence")))).otherwise(""))
    return rows.select("doc_id", "sent_id", "line_no", line.alias("line"))


def conllu_export(docs: DataFrame | None = None, annotations: DataFrame | None = None, *, engine: str) -> DataFrame:
    """Lines of the export by one engine, which must be named.

    ``annotated`` writes the trees of a token table that another annotator made (``sources.readers``: CoNLL-U or token JSON; columns doc_id, sent_id,
    tok_id, text, lemma, upos, xpos, morph, ws, is_space, dep, head_id). ``baseline`` annotates ``docs`` by the declared rules, which are no
    treebank. Neither stands in for the other: without its input an engine is an error, and so are documents with tokens that the annotations lack.
    """
    if engine not in ENGINES:
        raise ValueError(f"engine is one of {', '.join(ENGINES)}, not {engine!r}")
    if engine == "baseline":
        if docs is None:
            raise ValueError("the baseline engine annotates documents, and none are given")
        return conllu_lines(trees.laid_out_tree(trees.document_sentences(docs, laid_out=True)))
    if annotations is None:
        raise ValueError("the annotated engine needs a token table; name the baseline engine to have the documents annotated by rules")
    lines = conllu_lines(trees.with_tree(trees.gathered(annotations.select(*READ))))
    if docs is not None:
        asked = docs.filter(F.col("text").rlike(tx.TOKEN)) if "text" in docs.columns else docs  # a text without tokens has nothing to annotate
        named = annotations.select(F.col("doc_id").alias("_named")).distinct()
        missing = asked.select("doc_id").join(named, F.col("doc_id").eqNullSafe(F.col("_named")), "left_anti")
        missing = missing.select("doc_id", F.lit(0).alias("sent_id"), F.lit(0).alias("line_no"), F.raise_error(F.concat(
            F.lit("no annotations of document "), F.col("doc_id").cast("string"), F.lit("; name the baseline engine to have it annotated by rules"))).cast(
                "string").alias("line"))
        lines = lines.unionByName(missing)
    return lines


def header_lines(docs: DataFrame, header: tuple[str, ...] = HEADER) -> DataFrame:
    lines = F.array(*[F.struct(F.lit(i).alias("line_no"), F.lit(h).alias("line")) for i, h in enumerate(header)])
    return docs.select("doc_id", F.lit(-1).alias("sent_id"), F.inline(lines))


def conllu_mwt_lines(words: DataFrame, ranges: DataFrame, sents: DataFrame) -> DataFrame:
    """Word lines with multi-word ranges: per sentence the comments (kind 0), all range lines (1), the word lines (2), an empty line (3).

    ``words``: doc_id, sent_id, word_id, form, lemma, upos, xpos, feats, head (null becomes 0), deprel, misc;
    ``ranges``: doc_id, sent_id, first_id, last_id, form; ``sents``: doc_id, sent_id, sentence.
    """
    cell = lambda c: tx.conllu_field(F.col(c))
    word_lines = words.select(
        "doc_id", "sent_id", F.lit(2).alias("kind"), F.col("word_id").alias("pos"),
        F.concat_ws("\t", F.col("word_id").cast("string"), cell("form"), cell("lemma"), cell("upos"), cell("xpos"),
                    cell("feats"), F.coalesce("head", F.lit(0)).cast("string"), cell("deprel"), F.lit("_"),
                    cell("misc")).alias("line"))
    range_lines = ranges.select(
        "doc_id", "sent_id", F.lit(1).alias("kind"), F.col("first_id").alias("pos"),
        F.concat(F.col("first_id").cast("string"), F.lit("-"), F.col("last_id").cast("string"), F.lit("\t"), cell("form"),
                 F.lit("\t_" * 8)).alias("line"))
    entry = lambda kind, pos, line: F.struct(F.lit(kind).alias("kind"), F.lit(pos).alias("pos"), line.alias("line"))
    frame = sents.select("doc_id", "sent_id", F.inline(F.array(
        entry(0, 0, F.concat(F.lit("# sent_id = "), F.col("sent_id").cast("string"))), entry(0, 1, F.concat(F.lit("# text = "), cell("sentence"))),
        entry(3, 0, F.lit("")))))
    return frame.unionByName(range_lines).unionByName(word_lines)


def sort_feats_lines(lines: DataFrame) -> DataFrame:
    """Fix the order of the feature pairs in finished lines."""
    return lines.withColumn("line", tx.sort_feats(F.col("line")))
