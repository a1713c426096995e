"""Dependency trees in the row: a sentence is an array of tokens, heads are positions in it.

Everything is computed from arrays of one row, so a table of sentences needs no window, no join and no sort, and is exploded once at the end. Arcs and
trees of a batch of rows are array operations (``arcs``), whose work grows with the tokens only.
Positions count from 0; the numbers of the finished tree count from 1, with 0 for the root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import lexicons
from textloom.functions import text as tx
from textloom.operators import arcs
from textloom.operators.tokens import upos_rule


def listed_words() -> dict[str, dict[str, list[str]]]:
    """Words that the default lexicon lists, by language and part of speech."""
    groups: dict[str, dict[str, list[str]]] = {}
    for code, word, _, _, upos in lexicons.lexicon_rows():
        if upos:
            groups.setdefault(code, {}).setdefault(upos, []).append(word)
    return groups


def upos_of(toks: Column) -> Column:
    """The listed part of speech of each token of an array in a row with ``lang``, else that of the rules (hashed sets, no join).

    The language is settled once for a sentence. Most words are not listed, which one test of all listed words tells.
    """
    groups, others = listed_words(), sorted({code for code, _, _ in lexicons.UPOS_SUFFIXES} | set(listed_words()))

    def tags(code: str | None) -> Column:
        listed = groups.get(code, {})
        every = [w for words in listed.values() for w in words]

        def tag(t: Column, i: Column) -> Column:
            rule = upos_rule(code, t["lower"], t["text"], i, t["is_alpha"])
            if not every:
                return rule
            found = reduce(lambda out, u: out.when(t["lower"].isin(*listed[u]), u), sorted(listed), F.when(F.lit(False), ""))
            return F.when(t["is_alpha"] & t["lower"].isin(*every), found).otherwise(rule)

        return F.transform(toks, tag)

    upos = reduce(lambda out, code: out.when(F.col("lang") == code, tags(code)), others, F.when(F.lit(False), F.array().cast("array<string>")))
    return upos.otherwise(tags(None))


def with_upos(rows: DataFrame) -> DataFrame:
    """Add ``upos``, the part of speech of each of ``toks``."""
    return rows.withColumn("upos", upos_of(F.col("toks")))


def sentence_arrays(texts: Column) -> Column:
    """All sentences of the texts of a row with ``lang`` as one array of (sent_id, toks, upos): nothing is exploded."""
    def toks(sentence: Column) -> Column:
        pieces = F.regexp_extract_all(sentence, F.lit(tx.TOKEN_WITH_SPACE), F.lit(0))
        stripped = F.transform(pieces, lambda p: F.rtrim(p, F.lit(tx.BLANKS)))
        return F.transform(stripped, lambda t: F.struct(t.alias("text"), F.lower(t).alias("lower"), tx.starts_with_letter(t).alias("is_alpha")))

    every = F.flatten(F.transform(texts, lambda x: F.transform(tx.raw_sentences(x), lambda s, i: F.struct(i.alias("sent_id"), toks(s).alias("toks")))))
    return F.transform(every, lambda s: F.struct(s["sent_id"].alias("sent_id"), s["toks"].alias("toks"), upos_of(s["toks"]).alias("upos")))


def sentence_rows(docs: DataFrame, keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """One row for each sentence (doc_id, ``keep`` with lang, sent_id, sentence) with ``toks``, an array of (text, lower, spaced, is_alpha), and their ``upos``."""
    return with_tokens(docs.select("doc_id", *keep, F.posexplode(tx.raw_sentences(F.col("text"))).alias("sent_id", "_s")))


def with_tokens(rows: DataFrame) -> DataFrame:
    """The raw sentence ``_s`` of each row as ``sentence``, ``toks`` and ``upos``."""
    pieces = F.regexp_extract_all("_s", F.lit(tx.TOKEN_WITH_SPACE), F.lit(0))
    stripped = F.transform(pieces, lambda p: F.struct(F.rtrim(p, F.lit(tx.BLANKS)).alias("text"), F.length(p).alias("n")))
    rows = rows.withColumn("sentence", F.rtrim("_s", F.lit(tx.BLANKS))).withColumn("_p", stripped).drop("_s")
    rows = rows.withColumn("toks", F.transform("_p", lambda t: F.struct(
        t["text"].alias("text"), F.lower(t["text"]).alias("lower"), (t["n"] > F.length(t["text"])).alias("spaced"),
        tx.starts_with_letter(t["text"]).alias("is_alpha")))).drop("_p")
    return with_upos(rows)


def gathered(toks: DataFrame, *more: str, laid_out: bool = False) -> DataFrame:
    """One row for each sentence of a token table: ``toks`` in order with the text ``sentence``, the array ``upos``, and, where the table has them, ``dep`` and
    ``head`` (position in the sentence; null for heads outside of it). Space tokens are left out. A table that is laid out by document is not shuffled
    again; a sentence is one row, as it was in its text. ``more`` names columns that hold for a whole sentence. With ``laid_out`` heads are found by an
    expression of the row, which searches the ids of a sentence for each of its tokens."""
    arrays = [c for c in ("upos", "dep", "head_id") if c in toks.columns]
    kept = [c for c in toks.columns if c not in ("doc_id", "sent_id", "tok_id", *more)]
    spaced = F.concat("text", F.coalesce("ws", F.lit(""))) if "ws" in toks.columns else F.col("text")
    rows = toks.groupBy("doc_id", "sent_id").agg(
        F.array_sort(F.collect_list(F.struct("tok_id", *kept, spaced.alias("_spaced")))).alias("_t"), *[F.first(c).alias(c) for c in more])
    rows = rows.withColumn("toks", F.filter("_t", lambda t: ~t["is_space"]))
    rows = rows.withColumn("sentence", F.rtrim(F.array_join("_t._spaced", ""), F.lit(tx.BLANKS)))
    for c in arrays[:2]:
        rows = rows.withColumn(c, F.col(f"toks.{c}"))
    if "head_id" in arrays:
        search = F.transform("toks.head_id", lambda h: F.nullif(F.array_position(F.col("toks.tok_id"), h), F.lit(0)).cast("int") - 1)
        rows = rows.withColumn("head", search if laid_out else F.arrow_udf(arcs.positions, "array<int>")("toks.tok_id", "toks.head_id"))
    plain = [c for c in ("tok_id", *kept) if c not in arrays]
    return rows.withColumn("toks", F.transform("toks", lambda t: F.struct(*[t[c].alias(c) for c in plain]))).drop("_t")


def with_baseline(sents: DataFrame) -> DataFrame:
    """Add ``dep`` and ``head`` by the adjacency baseline, from ``upos``.

    Root: the first verb or auxiliary, else the first content token, else the first token. Adpositions hang on the previous content token and govern
    the content token right after them; determiners and other function words hang on the next content token; everything else on the previous one
    (or on the root).
    """
    rows = sents.withColumn("_a", F.arrow_udf(arcs.baseline, arcs.ARCS)("upos"))
    return rows.withColumn("dep", F.col("_a.dep")).withColumn("head", F.col("_a.head")).drop("_a")


def laid_out_baseline(sents: DataFrame) -> DataFrame:
    """``with_baseline`` by expressions of the row, for sentences that are grouped again afterwards: batches that pass through Python lose the layout of the table,
    and what follows would shuffle all tokens.
    """
    marks = lambda tags: F.array_join(F.transform("upos", lambda u: F.when(u.isin(*tags), "x").otherwise("-")), "")
    rows = sents.withColumn("_c", marks(arcs.CONTENT)).withColumn("_v", marks(("VERB", "AUX")))
    first = lambda c: F.nullif(F.instr(c, "x"), F.lit(0))
    rows = rows.withColumn("_root", F.coalesce(first("_v"), first("_c"), F.lit(1)) - 1).withColumn("_r", F.reverse("_c")).withColumn("_n", F.length("_c"))
    root = F.col("_root")

    def arc(u: Column, i: Column) -> Column:
        left = F.get("upos", i - 1)
        content = u.isin(*arcs.CONTENT)
        after = F.call_function("locate", F.lit("x"), F.col("_c"), i + 2)
        before = F.call_function("locate", F.lit("x"), F.col("_r"), F.col("_n") - i + 1)
        forward = F.when(after > 0, after - 1).otherwise(root)
        back = F.when((i > 0) & (before > 0), F.col("_n") - before).otherwise(root)
        dep = (F.when(i == root, "ROOT")
               .when(u == "ADP", "prep")
               .when(content & (left == "ADP"), "pobj")
               .when(content & (left == "AUX") & (i - 1 == root), "attr")
               .when(u == "DET", "det").when(u == "AUX", "aux").when(u == "PRON", "nsubj")
               .when(u == "CCONJ", "cc").when(u == "SCONJ", "mark").when(u == "PUNCT", "punct")
               .when(u == "ADJ", "amod").when(u == "ADV", "advmod").when(u == "NUM", "nummod")
               .when(u == "VERB", "conj")
               .when(u.isin("NOUN", "PROPN"), F.when(i > root, "dobj").otherwise("nsubj"))
               .otherwise("dep"))
        head = (F.when(i == root, i)
                .when(u == "ADP", back)
                .when(content & (left == "ADP"), i - 1)
                .when(content & (left == "AUX") & (i - 1 == root), root)
                .when(u.isin("DET", "AUX", "PRON", "CCONJ", "SCONJ", "PART"), forward)
                .when(u.isin("NOUN", "PROPN", "VERB"), root)
                .otherwise(back))
        return F.struct(dep.alias("dep"), head.cast("int").alias("head"))

    rows = rows.withColumn("_a", F.transform("upos", arc))
    return rows.withColumn("dep", F.col("_a.dep")).withColumn("head", F.col("_a.head")).drop("_c", "_v", "_r", "_n", "_root", "_a")


def with_tree(sents: DataFrame) -> DataFrame:
    """Add ``tree``: for each token its head number and relation before and after the repairs, a struct of arrays.

    * ``head_basic``, ``deprel_basic``: heads as numbers, labels as universal relations; an ``obl`` below a nominal is ``nmod``.
    * ``head_pp``, ``deprel_pp``: the object of an adposition becomes ``nmod`` of the adposition's head, the adposition its ``case``. An adposition that is
      the root keeps its place (re-attaching it would close a loop). If several objects claim one adposition, the last one keeps it.
    * ``head_idx``, ``deprel``: the first ``attr`` child of a verbal root becomes the root, the old root its ``cop``.

    Reads the arrays ``upos``, ``dep`` and ``head``; a head outside the sentence makes a token a child of 0.
    """
    return sents.withColumn("tree", F.arrow_udf(arcs.tree, arcs.TREES)("upos", "dep", "head"))


def ud_relation(dep: Column) -> Column:
    """Universal relation of a parser label; unknown labels are lower-cased."""
    same = [d for d, r in lexicons.UD_RELATIONS.items() if d == r]  # one hashed test settles most tokens
    cases = reduce(lambda out, d: out.when(dep == d, lexicons.UD_RELATIONS[d]), [d for d in lexicons.UD_RELATIONS if d not in same], F.when(dep.isin(*same), dep))
    return cases.otherwise(F.lower(dep))


def laid_out_tree(sents: DataFrame) -> DataFrame:
    """``with_tree`` by expressions of the row, for exports that start no Python workers and keep the layout of the table."""
    head, upos, dep = F.col("head"), F.col("upos"), F.col("dep")
    nominal = lambda c: c.isin(*arcs.NOMINAL)
    # What a token needs to know of its head, once for each token: the head's tag, and where the head itself hangs.
    rows = sents.withColumn("_u", F.transform(head, lambda h: F.get(upos, h))).withColumn("_g", F.transform(head, lambda h: F.get(head, h)))
    rows = rows.withColumn("_rel", F.transform(dep, lambda d, i: F.when(
        (d == "pobj") & F.coalesce(nominal(F.when(F.get("_u", i) == "ADP", F.get(upos, F.get("_g", i))).otherwise(F.get("_u", i))), F.lit(False)),
        "nmod").otherwise(ud_relation(d))))
    rows = rows.withColumn("_head", F.transform(dep, lambda d, i: F.when(d == "ROOT", 0).otherwise(F.coalesce(F.get(head, i) + 1, F.lit(0)))))
    # Movers from the last to the first, and the adposition that each of them claims.
    movers = F.filter(F.transform(dep, lambda d, i: F.when(
        (d == "pobj") & (F.get("_u", i) == "ADP") & (F.get("_g", i) != F.get(head, i)), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_m", F.reverse(movers))
    rows = rows.withColumn("_of", F.transform("_m", lambda i: F.get(head, i)))
    rows = rows.withColumn("_noun", F.transform(dep, lambda d, i: F.get("_m", F.array_position(F.col("_of"), i).cast("int") - 1) + 1))
    # 1: claimed by a noun behind, 2: moves itself, 0: neither.
    kind = F.transform(dep, lambda d, i: F.when(
        F.get("_noun", i).isNotNull() & (~F.array_contains("_m", i) | (F.get("_noun", i) > i + 1)), 1).when(F.array_contains("_m", i), 2).otherwise(0))
    rows = rows.withColumn("_k", F.when(F.size("_m") > 0, kind))
    turned = lambda one, two, base: F.transform("_k", lambda k, i: F.when(k == 0, F.get(base, i)).when(k == 1, one(i)).otherwise(two(i)))
    rows = rows.withColumn("_hp", F.coalesce(turned(lambda i: F.get("_noun", i), lambda i: F.get("_g", i) + 1, "_head"), "_head"))
    rows = rows.withColumn("_rp", F.coalesce(turned(lambda i: F.lit("case"), lambda i: F.lit("nmod"), "_rel"), "_rel"))
    root = F.nullif(F.array_position(dep, F.lit("ROOT")), F.lit(0)).cast("int")
    rows = rows.withColumn("_old", root)
    verbal = F.get(upos, F.col("_old") - 1).isin("AUX", "VERB") & F.array_contains(dep, "attr")
    rows = rows.withColumn("_new", F.when(verbal, F.array_min(F.transform(
        dep, lambda d, i: F.when((d == "attr") & (F.get(head, i) + 1 == F.col("_old")), i + 1)))))
    new, old = F.col("_new"), F.col("_old")
    rows = rows.withColumn("_hf", F.when(new.isNull(), F.col("_hp")).otherwise(F.transform(
        "_hp", lambda h, i: F.when(i + 1 == new, 0).when((i + 1 == old) | (h == old), new).otherwise(h))))
    rows = rows.withColumn("_rf", F.when(new.isNull(), F.col("_rp")).otherwise(F.transform(
        "_rp", lambda r, i: F.when(i + 1 == new, "root").when(i + 1 == old, "cop").otherwise(r))))
    tree = F.struct(*[F.col(c).alias(name) for c, name in zip(("_head", "_rel", "_hp", "_rp", "_hf", "_rf"), arcs.TREE)])
    return rows.withColumn("tree", tree).drop("_u", "_g", "_rel", "_head", "_m", "_of", "_noun", "_k", "_hp", "_rp", "_old", "_new", "_hf", "_rf")


def exploded(sents: DataFrame, *keys: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each token: ``keys``, its number ``idx`` from 1, the fields of ``toks``, its tag, and what there is of ``dep``, ``head`` and ``tree``;
    with ``only`` just those of them, so that no array is copied for nothing."""
    parts = [c for c in ("upos", "dep", "head") if c in sents.columns and (only is None or c in only)]
    fields = [c for c in (arcs.TREE if "tree" in sents.columns else ()) if only is None or c in only]
    toks = [F.col("toks").alias("t")] if only is None else []
    both = F.arrays_zip(*toks, *parts, *[F.col(f"tree.{c}").alias(c) for c in fields])
    rows = sents.select(*keys, F.posexplode(both).alias("_i", "_x"))
    return rows.select(*keys, (F.col("_i") + 1).alias("idx"), *(["_x.t.*"] if toks else []), *[f"_x.{c}" for c in (*parts, *fields)])


def document_sentences(docs: DataFrame, keep: tuple[str, ...] = ("lang",), laid_out: bool = False) -> DataFrame:
    """Sentences of documents with baseline arcs. Map-only: nothing is shuffled, sorted or joined. With ``laid_out`` rows keep the layout of ``docs``."""
    rows = sentence_rows(docs, keep)
    return laid_out_baseline(rows) if laid_out else with_baseline(rows)


def document_arcs(docs: DataFrame) -> DataFrame:
    """The arcs of ``baseline_arcs`` for documents, map-only: doc_id, sent_id, tok_id, dep, head_id (document positions)."""
    pieces = F.transform("_s", lambda s: F.size(F.regexp_extract_all(s, F.lit(tx.TOKEN_WITH_SPACE), F.lit(0))))
    rows = docs.select("doc_id", "lang", tx.raw_sentences(F.col("text")).alias("_s")).withColumn("start", F.arrow_udf(arcs.starts, "array<int>")(pieces))
    rows = rows.select("doc_id", "lang", F.posexplode(F.arrays_zip("_s", "start")).alias("sent_id", "_x")).select("doc_id", "lang", "sent_id", "_x._s", "_x.start")
    rows = exploded(with_baseline(with_tokens(rows)), "doc_id", "sent_id", "start", only=("dep", "head"))
    return rows.select("doc_id", "sent_id", (F.col("start") + F.col("idx") - 1).alias("tok_id"), "dep", (F.col("start") + F.col("head")).alias("head_id"))


def baseline_arcs(toks: DataFrame) -> DataFrame:
    """A token table with ``dep`` and ``head_id`` (document positions) of the baseline."""
    rows = laid_out_baseline(gathered(toks)).withColumn("_ids", F.col("toks.tok_id"))
    return exploded(rows, "doc_id", "sent_id", "_ids").withColumn("head_id", F.get("_ids", F.col("head"))).drop("_ids", "head", "idx")
