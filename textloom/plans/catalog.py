"""Registered queries: each name maps to a Spark job over the given tables and, where possible, its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import lexicons
from textloom.functions import schema
from textloom.functions import text as tx
from textloom.functions import vectors as vx
from textloom.operators import (assemble, clusters, conllu, embeddings, extract, keywords, language, lexical, profile, quality, readability,
                                runlog, sentiment, similarity, tokens, trees)
from textloom.plans import sqlparts as sp
from textloom.plans import views
from textloom.scale import spread_small
from textloom.sources import readers
from textloom.streaming import jobs

Job = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def add(fn: Job) -> Job:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema.fields])


# ---------------------------------------------------------------- extraction, filters, routing

# The check engine's patterns run in constant stack anyway and know no possessive form.
_HIDDEN, _MARKUP, _TITLE = tx._markup("*").values()
_NAMED_SQL = "MAP {" + ", ".join(f"{sp.lit(k)}: {sp.lit(v)}" for k, v in tx.NAMED_REFERENCES.items()) + "}"
_WINDOWS_SQL = "MAP {" + ", ".join(f"{k}: {sp.lit(v)}" for k, v in tx.WINDOWS_CODES.items()) + "}"
_POINT_SQL = f"""CASE WHEN n IS NULL OR n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n BETWEEN 128 AND 159 THEN coalesce({_WINDOWS_SQL}[CAST(n AS INTEGER)], '')
 WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(CAST(n AS INTEGER)) END"""
_REF_SQL = f"""CASE WHEN starts_with(r, '&#') THEN list_transform([CASE WHEN regexp_matches(r, '^&#[0-9]') THEN TRY_CAST(regexp_extract(r, '^&#([0-9]+)', 1) AS BIGINT)
   WHEN length(regexp_extract(r, '^&#[xX]0*([0-9a-fA-F]+)', 1)) <= 8 THEN TRY_CAST('0x' || regexp_extract(r, '^&#[xX]0*([0-9a-fA-F]+)', 1) AS BIGINT) END], lambda n: {_POINT_SQL})[1]
 ELSE coalesce({_NAMED_SQL}[substr(r, 2)], {_NAMED_SQL}[regexp_extract(r, {sp.lit(tx.OPEN_NAME)}, 1)] || regexp_extract(r, {sp.lit(tx.OPEN_NAME)}, 2), r) END"""


def _decoded_sql(source: str, column: str) -> str:
    """(page_id, t): the texts of ``column`` with their references decoded. References are looked up once each, as a table."""
    ref = sp.lit(tx.REFERENCE)
    return f"""SELECT p.page_id, coalesce(array_to_string(list_transform(range(len(parts)), lambda i: parts[i + 1] || coalesce(refs[i + 1], '')), ''), t) AS t FROM (
 SELECT page_id, any_value(parts) AS parts, any_value(t) AS t, list(x ORDER BY i) FILTER (i IS NOT NULL) AS refs FROM (
  SELECT s.page_id, s.t, s.parts, m.i, d.x FROM (SELECT page_id, {column} AS t, string_split_regex({column}, {ref}) AS parts FROM ({source})) s
  LEFT JOIN (SELECT page_id, unnest(found) AS r, unnest(range(len(found))) AS i FROM (SELECT page_id, regexp_extract_all({column}, {ref}) AS found FROM ({source}))) m ON m.page_id = s.page_id
  LEFT JOIN (SELECT r, {_REF_SQL} AS x FROM (SELECT DISTINCT unnest(regexp_extract_all({column}, {ref})) AS r FROM ({source}))) d ON d.r = m.r) GROUP BY page_id) p"""


_BARE_SQL = f"SELECT page_id, regexp_replace(html, {sp.lit(_MARKUP)}, ' ', 'g') AS bare FROM pages"
_HTML_SQL = f"SELECT page_id, trim(regexp_replace(t, '{tx.BLANK_RUN}', ' ', 'g')) AS text FROM ({_decoded_sql(_BARE_SQL, 'bare')})"
_SEEN_SQL = f"SELECT page_id, regexp_replace(html, {sp.lit(_HIDDEN)}, ' ', 'g') AS seen FROM pages"
_RAW_TITLE_SQL = f"SELECT page_id, regexp_matches(seen, {sp.lit(_TITLE)}) AS has, regexp_extract(seen, {sp.lit(_TITLE)}, 1) AS raw FROM ({_SEEN_SQL})"
_TITLE_SQL = f"""SELECT h.page_id, CASE WHEN has THEN regexp_replace(t, '^{tx.BLANK_RUN}|{tx.BLANK_RUN}$', '', 'g') ELSE 'Untitled' END AS title
 FROM ({_RAW_TITLE_SQL}) h JOIN ({_decoded_sql(_RAW_TITLE_SQL, 'raw')}) d ON d.page_id = h.page_id"""
_DOMAIN_SQL = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
_PATH_SQL = "coalesce(nullif(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^#]*)', 1), ''), '/')"


@query("html_to_text", _HTML_SQL)
def _html(spark, sf):
    return views.pages_rows(spark, sf).select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query("page_title", _TITLE_SQL)
def _title(spark, sf):
    return views.pages_rows(spark, sf).select("page_id", tx.page_title(F.col("html")).alias("title"))


@query("page_domain", f"SELECT page_id, {_DOMAIN_SQL} AS domain FROM pages")
def _domain(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", tx.url_domain(F.col("url")).alias("domain"))


@query("content_counts", f"SELECT doc_id, CAST(length(text) AS BIGINT) AS char_count, CAST(len({sp.blank_words('text')}) AS BIGINT) AS word_count FROM documents")
def _counts(spark, sf):
    return views.documents_rows(spark, sf).select("doc_id", *extract.content_counts(F.col("text")))


_VALID_DOCS_SQL = """SELECT doc_id, reason = '' AS is_valid, reason FROM (SELECT doc_id, array_to_string([x for x in [
 CASE WHEN text = '' THEN 'text_empty' END,
 CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 10 THEN 'text_too_short' END,
 CASE WHEN n_chars / 20000 > 1 THEN 'confidence_range' END] if x is not null], ',') AS reason FROM documents)"""


@query("valid_documents", _VALID_DOCS_SQL)
def _valid(spark, sf):
    rows = views.documents_rows(spark, sf)
    out = extract.with_validity(rows, text=F.col("text"), confidence=F.col("n_chars") / 20000.0)
    return out.select("doc_id", "is_valid", "reason")


@query("valid_pages", f"""SELECT page_id, reason = '' AS is_valid, reason FROM (SELECT page_id, array_to_string([x for x in [
 CASE WHEN title = '' THEN 'title_empty' END, CASE WHEN t = '' THEN 'text_empty' END, CASE WHEN html = '' THEN 'html_empty' END,
 CASE WHEN length(t) < 10 THEN 'text_too_short' END] if x is not null], ',') AS reason
 FROM (SELECT p.page_id, html, x.text AS t, title FROM pages p JOIN ({_HTML_SQL}) x ON x.page_id = p.page_id JOIN ({_TITLE_SQL}) y ON y.page_id = p.page_id))""")
def _valid_pages(spark, sf):
    rows = extract.extract_pages(views.pages_rows(spark, sf))
    return extract.with_validity(rows, text=F.col("text"), title=F.col("title"), html=F.col("html")).select(
        "page_id", "is_valid", "reason")


# Spelling variants of the language code of each document. Valid in both SQL dialects.
_CODE_SQL = """CASE n_chars % 7 WHEN 0 THEN concat(upper(lang), '-XX') WHEN 1 THEN concat(' ', lang, '_', source)
 WHEN 2 THEN CASE lang WHEN 'en' THEN 'ENG' WHEN 'de' THEN 'ger' WHEN 'fr' THEN 'fre' ELSE 'spa' END
 WHEN 3 THEN '' WHEN 4 THEN 'english' WHEN 5 THEN 'it-IT' ELSE lang END"""


def _norm_flat_sql(code: str) -> str:
    base = f"split_part(replace(lower(replace({code}, ' ', '')), '_', '-'), '-', 1)"
    cases = " ".join(f"WHEN {base} = '{a}' THEN '{b}'" for a, b in lexicons.THREE_LETTER_CODES.items())
    return f"CASE {cases} WHEN length({base}) = 2 THEN {base} ELSE 'en' END"


@query("normalize_lang", f"SELECT doc_id, raw, {_norm_flat_sql('raw')} AS code FROM (SELECT doc_id, {_CODE_SQL} AS raw FROM documents)")
def _normalize(spark, sf):
    rows = views.documents(spark, sf).select("doc_id", F.expr(_CODE_SQL).alias("raw"))
    return rows.select("doc_id", "raw", tx.normalize_lang(F.col("raw")).alias("code"))


@query("detect_language", sp.query(sp.DETECT, select="SELECT doc_id, language, round(language_confidence, 6) AS language_confidence FROM detected"))
def _detect(spark, sf):
    rows = language.detect_language(views.documents_rows(spark, sf))
    return rounded(rows.select("doc_id", "language", "language_confidence"))


@query("language_agreement", sp.query(sp.DETECT, select="""SELECT lang, language, count(*) AS n, count(*) FILTER (language_confidence < 0.6) AS uncertain FROM detected GROUP BY 1, 2"""))
def _agreement(spark, sf):
    rows = language.detect_language(views.documents_rows(spark, sf))
    return rows.groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("language_confidence") < 0.6).alias("uncertain"))


_OVERRIDE = "CASE WHEN n_chars % 11 = 0 THEN concat(' ', upper(lang), '-XX ') WHEN n_chars % 11 = 1 THEN '  ' END"
_DEFAULT = "CASE WHEN n_chars % 5 = 0 THEN 'DEU' WHEN n_chars % 5 = 1 THEN '' END"


@query("resolve_language", sp.query(sp.DETECT, select=f"""SELECT doc_id,
 CASE WHEN chosen IS NOT NULL THEN {_norm_flat_sql('chosen')} ELSE language END AS language,
 CASE WHEN chosen IS NOT NULL THEN 1.0 ELSE round(language_confidence, 6) END AS language_confidence
 FROM (SELECT *, coalesce(nullif(trim({_OVERRIDE}), ''), nullif(trim({_DEFAULT}), '')) AS chosen FROM detected)"""))
def _resolve(spark, sf):
    rows = language.detect_language(views.documents_rows(spark, sf))
    out = language.resolve_language(rows, F.expr(_OVERRIDE), F.expr(_DEFAULT))
    return rounded(out.select("doc_id", "language", "language_confidence"))


@query("low_confidence_docs", sp.query(sp.DETECT, select="SELECT doc_id, language, round(language_confidence, 6) AS language_confidence FROM detected WHERE language_confidence < 0.6"))
def _low(spark, sf):
    rows = language.detect_language(views.documents_rows(spark, sf))
    low = rows.filter(language.is_low_confidence(F.col("language_confidence")))
    return rounded(low.select("doc_id", "language", "language_confidence"))


@query("route_language", sp.query(
    sp.values("dim", "code, model", sorted(lexicons.LANGUAGE_MODELS.items())),
    select=f"""SELECT doc_id, language, model, CASE WHEN model IS NULL THEN concat('no model for language ''', raw,
 '''; there are models for ''de'', ''en'', ''es'', ''fr''') END AS error FROM (SELECT doc_id, raw, {_norm_flat_sql('raw')} AS language
 FROM (SELECT doc_id, {_CODE_SQL} AS raw FROM documents)) LEFT JOIN dim ON code = language"""))
def _route(spark, sf):
    rows = views.documents(spark, sf).select("doc_id", F.expr(_CODE_SQL).alias("raw"))
    return language.route_language(rows, F.col("raw")).select("doc_id", "language", "model", "error")


_CSV = "concat(lang, ', ', upper(lang), '_XX,, fra ,', source, ',DEU,', lang)"
_CSV_ITEMS = "[" + _norm_flat_sql("trim(c)") + " for c in string_split(csv, ',') if trim(c) <> '']"


@query("parse_lang_csv", f"""SELECT doc_id, array_to_string([codes[i] for i in range(1, len(codes) + 1) if list_position(codes, codes[i]) = i], ',') AS codes
 FROM (SELECT doc_id, {_CSV_ITEMS} AS codes FROM (SELECT doc_id, {_CSV} AS csv FROM documents))""")
def _csv(spark, sf):
    rows = views.documents(spark, sf).select("doc_id", F.expr(_CSV).alias("csv"))
    return rows.select("doc_id", F.array_join(tx.language_csv(F.col("csv")), ",").alias("codes"))


@query("output_key", f"""SELECT page_id, concat(CASE WHEN s = '' THEN 'output' ELSE s END, '_', page_id) AS output_key FROM (SELECT page_id,
 regexp_replace(regexp_replace(trim(replace(CASE WHEN d = '' THEN 'url' ELSE d END, 'www.', '')), '[^\\p{{L}}\\p{{N}}_-]', '-', 'g'), '^-+|-+$', '', 'g') AS s
 FROM (SELECT page_id, {_DOMAIN_SQL} AS d FROM pages))""")
def _key(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", tx.output_key(F.col("url"), F.col("page_id")).alias("output_key"))


@query("crawl_plan", f"""SELECT page_id, host, visit_no, (visit_no - 1) * 2.0::DOUBLE AS start_offset_s FROM (
 SELECT page_id, {_DOMAIN_SQL} AS host, row_number() OVER (PARTITION BY {_DOMAIN_SQL} ORDER BY page_id) AS visit_no FROM pages)""")
def _crawl(spark, sf):
    return extract.crawl_plan(views.table(spark, sf, "pages"))


@query("robots_filter", sp.query(
    sp.values("rules", "host, seq, prefix, allow", views.ROBOTS_RULES),
    f"p AS (SELECT page_id, url, {_DOMAIN_SQL} AS host, {_PATH_SQL} AS path FROM pages)",
    select="""SELECT p.page_id, p.url, coalesce(arg_min(r.allow, r.seq), true) AS allowed FROM p
 LEFT JOIN rules r ON r.host = p.host AND starts_with(p.path, r.prefix) GROUP BY 1, 2"""))
def _robots(spark, sf):
    return extract.robots_filter(views.table(spark, sf, "pages"), views.robots_rules(spark))


@query("redact_messages", """SELECT doc_id, k <> '' AS had_secret, CASE WHEN k <> '' THEN replace(text, k, '***REDACTED***') ELSE text END AS message
 FROM (SELECT doc_id, text, regexp_extract(text, 'token = "([0-9a-f]{40})"', 1) AS k FROM documents)""")
def _redact(spark, sf):
    rows = views.documents_rows(spark, sf)
    key = F.regexp_extract("text", 'token = "([0-9a-f]{40})"', 1)
    return rows.select("doc_id", "text", key.alias("k")).select(
        "doc_id", (F.col("k") != "").alias("had_secret"), tx.redact(F.col("text"), F.col("k")).alias("message"))


@query("batch_status", f"""SELECT CASE WHEN is_valid THEN 'ok' ELSE 'failed' END AS status, count(*) AS n FROM ({_VALID_DOCS_SQL}) GROUP BY 1""")
def _status(spark, sf):
    rows = views.documents_rows(spark, sf)
    return extract.batch_status(extract.with_validity(rows, text=F.col("text"), confidence=F.col("n_chars") / 20000.0))


@query("batch_gate", f"""SELECT count(*) AS total, count(*) FILTER (NOT is_valid) AS failed, count(*) FILTER (NOT is_valid) = 0 AS success FROM ({_VALID_DOCS_SQL})""")
def _gate(spark, sf):
    rows = views.documents_rows(spark, sf)
    return extract.batch_succeeded(extract.with_validity(rows, text=F.col("text"), confidence=F.col("n_chars") / 20000.0))


def _error_case(pick: int) -> str:
    return " ".join(f"WHEN kind = '{k}' THEN {sp.lit(v[pick])}" for k, v in extract.ERRORS.items())


@query("error_rows", sp.query(
    sp.values("dim", "code, model", sorted(lexicons.LANGUAGE_MODELS.items())),
    f"""k AS (SELECT doc_id, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 10 THEN 'GENERIC' WHEN n_chars % 97 = 0 THEN 'FETCH'
 WHEN model IS NULL THEN 'MODEL' END AS kind FROM (SELECT *, {_norm_flat_sql(_CODE_SQL)} AS nl FROM documents) LEFT JOIN dim ON code = nl)""",
    select=f"""SELECT doc_id, CASE {_error_case(0)} ELSE 0 END AS code, CASE {_error_case(1)} ELSE 'OK' END AS name,
 CASE {_error_case(2)} ELSE '' END AS message, CASE WHEN kind IS NOT NULL THEN concat('{{"error":{{"code":', CASE {_error_case(0)} END, ',"name":"',
 CASE {_error_case(1)} END, '","message":"', CASE {_error_case(2)} END, '"}}}}') END AS error_json FROM k"""))
def _errors(spark, sf):
    rows = views.documents_rows(spark, sf).withColumn("raw", F.expr(_CODE_SQL))
    rows = language.route_language(rows, F.col("raw"))
    kind = (F.when(F.length(tx.strip(F.col("text"))) < extract.MIN_CHARS, "GENERIC").when(F.col("n_chars") % 97 == 0, "FETCH")
            .when(F.col("model").isNull(), "MODEL"))
    return rows.select("doc_id", kind.alias("kind")).select("doc_id", *extract.error_columns(F.col("kind")))


# Console output around a JSON object, some of it unusable. Valid in both SQL dialects.
_NOISY = """concat('INFO {start} ', CASE WHEN n_chars % 3 = 0 THEN '' ELSE 'loading ' END, '{', CASE WHEN n_chars % 5 = 0 THEN '"id": 0, ' ELSE '"tool": "textloom", ' END,
 '"doc": ', CAST(doc_id AS STRING), ', "lang": "', lang, '"', CASE WHEN n_chars % 7 = 0 THEN '' ELSE '}' END, ' done')"""
_MARKER = '"tool": "textloom"'


@query("extract_json", f"""SELECT doc_id, CASE WHEN json_valid(cut) THEN CAST(json_extract_string(cut, '$.doc') AS BIGINT) END AS doc, coalesce(json_valid(cut), false) AS found
 FROM (SELECT doc_id, CASE WHEN st > 0 AND en > st THEN substr(noisy, CAST(st AS BIGINT), CAST(en - st + 1 AS BIGINT)) END AS cut FROM (SELECT doc_id, noisy, CASE WHEN contains(noisy, {sp.lit(_MARKER)})
 THEN strpos(noisy, {sp.lit(_MARKER)}) - strpos(reverse(substr(noisy, 1, strpos(noisy, {sp.lit(_MARKER)}) - 1)), '{{') ELSE strpos(noisy, '{{') END AS st,
 CASE WHEN contains(noisy, '}}') THEN length(noisy) - strpos(reverse(noisy), '}}') + 1 ELSE 0 END AS en FROM (SELECT doc_id, {_NOISY} AS noisy FROM documents)))""")
def _extract_json(spark, sf):
    rows = views.documents(spark, sf).select("doc_id", F.expr(_NOISY).alias("noisy"))
    rows = rows.select("doc_id", tx.embedded_json(F.col("noisy"), _MARKER).alias("cut"))
    return rows.select("doc_id", F.try_variant_get(F.try_parse_json("cut"), "$.doc", "bigint").alias("doc"), F.col("cut").isNotNull().alias("found"))


_PATHS = {"language.code": None, "language.model": None, "content.char_count": 500.0, "content.word_count": 0.0, "missing.key": None}


@query("json_path_checks", sp.query(
    sp.PAYLOADS, sp.values("paths", "path, low", _PATHS.items()),
    select="""SELECT doc_id, path, v IS NOT NULL AS present, v IS NOT NULL AND (low IS NULL OR coalesce(try_cast(v AS DOUBLE) >= low, false)) AS ok
 FROM (SELECT doc_id, path, low, json_extract_string(payload, '$.' || path) AS v FROM (SELECT doc_id, CASE WHEN json_valid(payload) THEN payload ELSE '{}' END AS payload FROM pl), paths)"""))
def _paths(spark, sf):
    rows = views.payload_rows(spark, sf)
    rows = rows.withColumn("payload", F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")).otherwise("{}"))
    return extract.json_path_checks(rows, "doc_id", "payload", _PATHS)


# What the users of every document ask for. Valid in both SQL dialects.
_ENABLE = """CASE n_chars % 4 WHEN 0 THEN '' WHEN 1 THEN 'pos,ner,pos' WHEN 2 THEN concat('lexical_stats,embeddings,', source, ',keywords') ELSE 'sentiment,keywords,dependency' END"""
_DISABLE = "CASE n_chars % 3 WHEN 0 THEN '' WHEN 1 THEN 'keywords,readability' ELSE concat('sentiment,dependency,pos,', lang) END"
_FLAGS = ("n_chars % 5 = 0", "n_chars % 7 < 3")


def _flag_sql(names: str, name: str, flag: str) -> str:
    return (f"CASE WHEN NOT ({flag}) THEN list_filter({names}, lambda x: x <> '{name}') WHEN list_contains({names}, '{name}') THEN {names} ELSE list_append({names}, '{name}') END")


@query("select_analyzers", f"""SELECT doc_id, array_to_string(CASE WHEN list_contains(c, 'dependency') THEN c ELSE list_append(c, 'dependency') END, ',') AS names FROM (
 SELECT doc_id, {_flag_sql('b', 'sentiment', _FLAGS[1])} AS c FROM (SELECT *, {_flag_sql('a', 'embeddings', _FLAGS[0])} AS b FROM (
 SELECT doc_id, n_chars, list_filter([e[i] for i in range(1, len(e) + 1) if list_position(e, e[i]) = i],
   lambda x: x IN {sp.in_list(assemble.available_analyzers())} AND NOT list_contains(string_split({_DISABLE}, ','), x)) AS a
 FROM (SELECT *, CASE WHEN {_ENABLE} = '' THEN {assemble.available_analyzers()} ELSE string_split({_ENABLE}, ',') END AS e FROM documents))))""")
def _select(spark, sf):
    names = lambda csv: F.filter(F.split(F.expr(csv), ","), lambda n: n != "")
    picked = assemble.chosen_analyzers(names(_ENABLE), names(_DISABLE), *[F.expr(f) for f in _FLAGS])
    return views.documents(spark, sf).select("doc_id", F.array_join(picked, ",").alias("names"))


# ---------------------------------------------------------------- tokens, sentences, annotations

@query("tokens", sp.query(sp.RAW_TOK, select="SELECT doc_id, sent_id, CAST(tok_id AS INTEGER) AS tok_id, text, ws, is_alpha FROM tok3"))
def _tokens(spark, sf):
    return tokens.raw_tokens(views.documents_rows(spark, sf)).select("doc_id", "sent_id", "tok_id", "text", "ws", "is_alpha")


@query("sentences", sp.query(sp.SENT, select=f"SELECT doc_id, sent_id, rtrim(s, {sp.BLANKS}) AS sentence FROM sent"))
def _sentences(spark, sf):
    return tokens.sentences(views.documents_rows(spark, sf))


@query("content_tokens", sp.query(sp.TOK, select="SELECT doc_id, CAST(tok_id AS INTEGER) AS tok_id, text FROM tok WHERE is_alpha AND NOT is_stop"))
def _content(spark, sf):
    toks = tokens.tokens(views.documents_rows(spark, sf), clustered=False)
    return tokens.content_tokens(toks).select("doc_id", "tok_id", "text")


@query("lemmas", sp.query(sp.TOK, select="SELECT doc_id, CAST(tok_id AS INTEGER) AS tok_id, lemma FROM tok"))
def _lemmas(spark, sf):
    return tokens.tokens(views.documents_rows(spark, sf), clustered=False).select("doc_id", "tok_id", "lemma")


@query("pos_tags", sp.query(sp.TOK, select="SELECT doc_id, CAST(tok_id AS INTEGER) AS tok_id, upos, xpos FROM tok"))
def _pos_tags(spark, sf):
    return tokens.tokens(views.documents_rows(spark, sf), clustered=False).select("doc_id", "tok_id", "upos", "xpos")


@query("entities", sp.query(sp.ENTS, select='SELECT doc_id, "start", "end", label, text FROM ents'))
def _entities(spark, sf):
    return tokens.entities(views.documents_rows(spark, sf))


@query("dep_arcs", sp.query(sp.ARCS, select="SELECT doc_id, CAST(tok_id AS INTEGER) AS tok_id, dep, head_id FROM arcs"))
def _arcs(spark, sf):
    return trees.document_arcs(views.documents_rows(spark, sf)).select("doc_id", "tok_id", "dep", "head_id")


def _tree_sql(cols: str, where: str = "") -> str:
    return sp.query(sp.TREE, select=f"SELECT doc_id, sent_id, CAST(idx AS INTEGER) AS idx, {cols} FROM tree {where}")


@query("conllu_heads", _tree_sql("CAST(head_basic AS INTEGER) AS head_basic"))
def _heads(spark, sf):
    return trees.exploded(views.trees_of(spark, sf), "doc_id", "sent_id", only=("head_basic",))


@query("conllu_deprel", _tree_sql("dep, deprel_basic"))
def _deprel(spark, sf):
    return trees.exploded(views.trees_of(spark, sf), "doc_id", "sent_id", only=("dep", "deprel_basic"))


@query("conllu_pp", _tree_sql("CAST(head_pp AS INTEGER) AS head_pp, deprel_pp"))
def _pp(spark, sf):
    return trees.exploded(views.trees_of(spark, sf), "doc_id", "sent_id", only=("head_pp", "deprel_pp"))


@query("conllu_copula", _tree_sql("CAST(head_idx AS INTEGER) AS head_idx, deprel"))
def _copula(spark, sf):
    return trees.exploded(views.trees_of(spark, sf), "doc_id", "sent_id", only=("head_idx", "deprel"))


@query("conllu_fields", sp.query(sp.TOK, select=f"""SELECT doc_id, CAST(tok_id AS INTEGER) AS tok_id, {sp.conllu_field('text')} AS form, {sp.CONLLU_FEATS} AS feats,
 CASE WHEN ws = '' THEN 'SpaceAfter=No' ELSE '_' END AS misc FROM tok"""))
def _fields(spark, sf):
    toks = tokens.tokens(views.documents_rows(spark, sf), clustered=False)
    return toks.select("doc_id", "tok_id", tx.conllu_field(F.col("text")).alias("form"), tx.conllu_feats(F.col("morph")).alias("feats"),
                       F.when(F.col("ws") == "", "SpaceAfter=No").otherwise("_").alias("misc"))


def _lines_sql(engine: str, p: str = "") -> str:
    return f"""SELECT {engine} doc_id, sent_id, CAST(idx + 1 AS INTEGER) AS line_no, {sp.TOKEN_LINE} AS line FROM {p}tree
 UNION ALL SELECT {engine} doc_id, sent_id, 0, concat('# sent_id = ', sent_id) FROM sent
 UNION ALL SELECT {engine} doc_id, sent_id, 1, concat('# text = ', {sp.conllu_field('s')}) FROM sent
 UNION ALL SELECT {engine} doc_id, sent_id, CAST(max(idx) + 2 AS INTEGER), '' FROM {p}tree GROUP BY doc_id, sent_id"""


@query("conllu_lines", sp.query(sp.TREE, select=_lines_sql("")))
def _lines(spark, sf):
    return conllu.conllu_export(views.documents_rows(spark, sf), engine="baseline")


@query("conllu_engine", sp.query(sp.TREE, sp.FOREIGN_ARCS, sp.tree_ctes("x_"), select=_lines_sql("'baseline' AS engine,") + " UNION ALL " + _lines_sql("'annotated' AS engine,", "x_")))
def _engine(spark, sf):
    docs, toks = views.documents_rows(spark, sf), views.annotated_tokens(spark, sf)
    return conllu.conllu_export(docs, engine="baseline").withColumn("engine", F.lit("baseline")).unionByName(
        conllu.conllu_export(docs, toks, engine="annotated").withColumn("engine", F.lit("annotated")))


@query("conllu_sort_feats", sp.query(
    sp.TOK, """fs AS (SELECT *, string_split(CASE WHEN morph = '' THEN '_' ELSE concat('number=Sing|', morph, '|Abbr=Yes|', upos, '=1') END, '|') AS f FROM tok)""",
    select="""SELECT doc_id, CAST(tok_id AS INTEGER) AS tok_id, concat_ws(chr(9), tok_id, text, lemma, upos, xpos,
 array_to_string([x.p for x in list_sort([{'k': lower(f[i]), 'i': i, 'p': f[i]} for i in range(1, len(f) + 1)])], '|'), '0', 'dep', '_', '_') AS line FROM fs"""))
def _sort_feats(spark, sf):
    toks = tokens.tokens(views.documents_rows(spark, sf), clustered=False)
    feats = F.when(F.col("morph") == "", "_").otherwise(
        F.concat(F.lit("number=Sing|"), F.col("morph"), F.lit("|Abbr=Yes|"), F.col("upos"), F.lit("=1")))
    line = F.concat_ws("\t", F.col("tok_id").cast("string"), "text", "lemma", "upos", "xpos", feats, F.lit("0"), F.lit("dep"), F.lit("_"), F.lit("_"))
    return conllu.sort_feats_lines(toks.select("doc_id", "tok_id", line.alias("line")))


@query("conllu_mwt_lines", sp.query(
    sp.TOK, sp.values("con", "lang, form, w1, w2", [(*k, *v) for k, v in views.CONTRACTIONS.items()]),
    """m0 AS (SELECT t.*, c.w1, c.w2, sent_pos + 1 + sum(CASE WHEN c.w1 IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id
 ROWS UNBOUNDED PRECEDING) - CASE WHEN c.w1 IS NULL THEN 0 ELSE 1 END AS w_id FROM tok t LEFT JOIN con c ON c.form = t.lower AND c.lang = t.lang)""",
    select=f"""SELECT doc_id, sent_id, 1 AS kind, CAST(w_id AS INTEGER) AS pos, concat(w_id, '-', w_id + 1, chr(9), {sp.conllu_field('text')}, repeat(chr(9) || '_', 8)) AS line FROM m0 WHERE w1 IS NOT NULL
 UNION ALL SELECT doc_id, sent_id, 2, CAST(w_id AS INTEGER), concat_ws(chr(9), w_id, coalesce(w1, {sp.conllu_field('text')}), coalesce(w1, {sp.conllu_field('lemma')}), upos, xpos, '_', '0', '_', '_', '_') FROM m0
 UNION ALL SELECT doc_id, sent_id, 2, CAST(w_id + 1 AS INTEGER), concat_ws(chr(9), w_id + 1, w2, w2, upos, xpos, '_', '0', '_', '_', '_') FROM m0 WHERE w1 IS NOT NULL
 UNION ALL SELECT doc_id, sent_id, unnest([0, 0, 3]), unnest([0, 1, 0]), unnest(['# sent_id = ' || sent_id, '# text = ' || {sp.conllu_field('s')}, '']) FROM sent"""))
def _mwt(spark, sf):
    words, ranges = views.split_contractions(views.tokens_of(spark, sf))
    return conllu.conllu_mwt_lines(words, ranges, tokens.sentences(views.documents_rows(spark, sf)))


# ---------------------------------------------------------------- analyzers

@query("lexical_stats", sp.query(sp.LEXICAL, select="SELECT * FROM lexical"))
def _lexical(spark, sf):
    return rounded(lexical.lexical_stats(views.documents_rows(spark, sf)))


_COUNTS = "cnt AS (SELECT doc_id, lemma, count(*) AS c FROM tok WHERE is_alpha AND NOT is_stop GROUP BY 1, 2)"


@query("top_lemmas", sp.query(sp.TOK, _COUNTS, select="""SELECT doc_id, lemma, c AS "count", CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, lemma) AS rank FROM cnt) WHERE rank <= 20"""))
def _top(spark, sf):
    return lexical.top_lemmas(views.tokens_of(spark, sf)).select("doc_id", "lemma", "count", "rank")


@query("upos_counts", sp.query(sp.TOK, select='SELECT doc_id, upos, count(*) AS "count" FROM tok GROUP BY 1, 2'))
def _upos(spark, sf):
    return lexical.upos_counts(views.tags_of(spark, sf)).select("doc_id", "upos", "count")


@query("upos_ratios", sp.query(sp.TOK, select="""SELECT doc_id, upos, round(c / sum(c) OVER (PARTITION BY doc_id), 6) AS ratio
 FROM (SELECT doc_id, upos, count(*) AS c FROM tok GROUP BY 1, 2)"""))
def _ratios(spark, sf):
    return rounded(lexical.upos_counts(views.tags_of(spark, sf)).select("doc_id", "upos", "ratio"))


@query("top_lemmas_by_upos", sp.query(sp.TOK, select="""SELECT doc_id, upos, lemma, c AS "count", CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id, upos ORDER BY c DESC, f) AS rank FROM (SELECT doc_id, upos, lemma, count(*) AS c, min(tok_id) AS f
 FROM tok WHERE is_alpha AND NOT is_stop GROUP BY 1, 2, 3)) WHERE rank <= 5"""))
def _top_upos(spark, sf):
    return lexical.top_lemmas_by_upos(views.tokens_of(spark, sf)).select("doc_id", "upos", "lemma", "count", "rank")


@query("dep_counts", sp.query(sp.ARCS, select='SELECT doc_id, dep, count(*) AS "count" FROM arcs GROUP BY 1, 2'))
def _dep_counts(spark, sf):
    return lexical.dep_counts(trees.exploded(views.sentences_of(spark, sf), "doc_id", only=("dep",)))


@query("head_pos_dep", sp.query(sp.ARCS, select="""SELECT doc_id, arc, c AS "count", CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) AS rank
 FROM (SELECT a.doc_id, h.upos || '->' || a.dep AS arc, count(*) AS c, min(a.tok_id) AS f FROM arcs a JOIN arcs h ON h.doc_id = a.doc_id AND h.tok_id = a.head_id GROUP BY 1, 2)) WHERE rank <= 20"""))
def _head_pos(spark, sf):
    return lexical.head_pos_dep(views.sentences_of(spark, sf)).select("doc_id", "arc", "count", "rank")


@query("ner_counts", sp.query(sp.ENTS, select="""SELECT d.doc_id, e.label, count(e.label) AS "count", count(e.label) > 0 AS supported
 FROM documents d LEFT JOIN ents e ON e.doc_id = d.doc_id GROUP BY 1, 2"""))
def _ner(spark, sf):
    docs = views.documents_rows(spark, sf)
    spans = tokens.entities(docs)
    rows = docs.select("doc_id").join(lexical.ner_counts(spans), "doc_id", "left")
    return rows.select("doc_id", "label", F.coalesce("count", F.lit(0)).alias("count"), F.col("count").isNotNull().alias("supported"))


@query("ner_examples", sp.query(sp.ENTS, select="""SELECT doc_id, label, CAST(rank AS INTEGER) AS rank, text FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY "start") AS rank FROM ents) WHERE rank <= 10"""))
def _ner_examples(spark, sf):
    return lexical.ner_examples(tokens.entities(views.documents_rows(spark, sf))).select("doc_id", "label", "rank", "text")


def _read_query(name: str, cols: list[str]) -> None:
    @query(name, sp.query(sp.READ, select=f"SELECT doc_id, {', '.join(cols)} FROM readab"))
    def _read(spark, sf):
        return readability.scores(views.documents_rows(spark, sf)).select("doc_id", *cols)


_read_query("readability", ["flesch_reading_ease", "flesch_kincaid_grade", "smog_index", "automated_readability_index", "coleman_liau_index"])
_read_query("linsear_write", ["linsear_write_formula"])
_read_query("dale_chall", ["dale_chall_readability_score"])
_read_query("difficult_words", ["difficult_words"])
_read_query("syllables", ["words", "syllables"])

_GRADES = ["flesch_kincaid_grade", "smog_index", "automated_readability_index", "coleman_liau_index", "linsear_write_formula",
           "dale_chall_readability_score"]
_VOTES = ", ".join(f"CAST({f}({g}) AS BIGINT)" for g in _GRADES for f in ("floor", "ceil"))


def _ord_sql(n: str) -> str:
    # Spark's pmod keeps the remainder non-negative.
    return (f"concat({n}, CASE WHEN (({n} % 100) + 100) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN (({n} % 10) + 10) % 10 = 1 THEN 'st' "
            f"WHEN (({n} % 10) + 10) % 10 = 2 THEN 'nd' WHEN (({n} % 10) + 10) % 10 = 3 THEN 'rd' ELSE 'th' END)")


_STANDARD = f"""votes AS (SELECT doc_id, unnest([CAST(CASE WHEN flesch_reading_ease >= 90 THEN 5 WHEN flesch_reading_ease >= 80 THEN 6
 WHEN flesch_reading_ease >= 70 THEN 7 WHEN flesch_reading_ease >= 60 THEN 8 WHEN flesch_reading_ease >= 50 THEN 10 WHEN flesch_reading_ease >= 40 THEN 11
 WHEN flesch_reading_ease >= 30 THEN 12 ELSE 13 END AS BIGINT), {_VOTES}]) AS g FROM readab),
tally AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, g) AS r FROM votes GROUP BY 1, 2),
standard AS (SELECT doc_id, g AS consensus_grade, concat({_ord_sql('(g - 1)')}, ' and ', {_ord_sql('g')}, ' grade') AS text_standard FROM tally WHERE r = 1)"""


@query("text_standard", sp.query(sp.READ, _STANDARD, select="SELECT * FROM standard"))
def _standard(spark, sf):
    scored = readability.scores(views.documents_rows(spark, sf))
    return readability.text_standard(scored).select("doc_id", "consensus_grade", "text_standard")


@query("keywords_frequency", sp.query(sp.TOK, _COUNTS, select="""SELECT doc_id, lemma AS keyword, c AS "count", CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
 SELECT *, c / sum(c) OVER (PARTITION BY doc_id) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, lemma) AS rank FROM cnt) WHERE rank <= 20"""))
def _kw(spark, sf):
    return rounded(keywords.keywords_frequency(views.tokens_of(spark, sf)).select("doc_id", "keyword", "count", "rank", "score"))


_YAKE = """yw AS (SELECT doc_id, sent_id, sent_pos, lower, text, is_stop, lag(lower) OVER o AS lf, lead(lower) OVER o AS rt FROM tok WHERE is_alpha
  WINDOW o AS (PARTITION BY doc_id, sent_id ORDER BY tok_id)),
yt AS (SELECT doc_id, lower AS term, CAST(count(*) AS DOUBLE) AS tf, count(*) FILTER (upper(text) = text AND lower(text) <> text) AS ta,
   count(*) FILTER (upper(substr(text,1,1)) = substr(text,1,1) AND lower(substr(text,1,1)) <> substr(text,1,1) AND sent_pos > 0) AS tu,
   median(sent_id) AS med, count(DISTINCT sent_id) AS ts, count(DISTINCT lf) AS ld, count(lf) AS ln, count(DISTINCT rt) AS rd, count(rt) AS rn
  FROM yw WHERE NOT is_stop AND length(lower) >= 3 GROUP BY 1, 2),
yd AS (SELECT *, sum(tf) OVER d AS sm, sum(tf * tf) OVER d AS sq, count(*) OVER d AS n, max(tf) OVER d AS mx FROM yt WINDOW d AS (PARTITION BY doc_id)),
ye AS (SELECT y.doc_id, term, tf, greatest(ta, tu) / (1.0::DOUBLE + ln(tf)) AS tc, ln(ln(3.0::DOUBLE + med)) AS tp,
   tf / (sm / n + sqrt(greatest(0.0::DOUBLE, sq / n - (sm / n) * (sm / n)))) AS tn,
   1.0::DOUBLE + (coalesce(ld / nullif(y.ln, 0), 0) + coalesce(rd / nullif(rn, 0), 0)) * tf / mx AS tr, ts / len(ss) AS tsp
  FROM yd y JOIN sent0 s ON s.doc_id = y.doc_id),
yf AS (SELECT *, tr * tp / (tc + tn / tr + tsp / tr) AS s FROM ye),
yg AS (SELECT doc_id, term AS keyword, s / (tf * (1.0::DOUBLE + s)) AS raw FROM yf),
yh AS (SELECT doc_id, keyword, round(CASE WHEN raw > 0 THEN 1.0::DOUBLE / raw ELSE 0.0::DOUBLE END, 6) AS score FROM yg)"""


@query("keywords_yake", sp.query(sp.TOK, _YAKE, select="""SELECT doc_id, keyword, score, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, keyword) AS rank FROM yh) WHERE rank <= 20"""))
def _yake(spark, sf):
    rows = keywords.keywords_yake(keywords.sentence_words(views.documents(spark, sf)))
    return rows.select("doc_id", "keyword", "score", "rank")


_ALL_VALENCE = {**lexicons.VALENCE, **views.INVENTED_VALENCE}
_TURN_SOURCE = f"SELECT {views.TURN_ID} AS doc_id, text FROM conversations"
_LABEL_SQL = "CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END"


@query("sentiment_valence", sp.query(sp.sentiment_ctes("SELECT doc_id, text FROM documents", _ALL_VALENCE), select="SELECT * FROM senti"))
def _valence(spark, sf):
    return sentiment.valence_scores(views.documents_rows(spark, sf), views.valence(spark))


@query("sentiment_label", sp.query(sp.sentiment_ctes(_TURN_SOURCE, _ALL_VALENCE), select=f"SELECT doc_id AS turn_id, {_LABEL_SQL} AS label, abs(compound) AS score FROM senti"))
def _label(spark, sf):
    rows = sentiment.sentiment_label(views.turns(spark, sf), views.valence(spark))
    return rows.withColumnRenamed("doc_id", "turn_id")


_POLARITY_SQL = f"""SELECT doc_id, polarity, subjectivity, CASE WHEN polarity > 0.1 THEN 'positive' WHEN polarity < -0.1 THEN 'negative' ELSE 'neutral' END AS label, abs(polarity) AS score FROM (
 SELECT d.doc_id, round(coalesce(CAST(sum(CAST(round(p * 1000000) AS BIGINT)) AS DOUBLE) / 1000000 / nullif(count(p), 0), 0.0), 6) AS polarity,
 round(coalesce(CAST(sum(CAST(round(s * 1000000) AS BIGINT)) AS DOUBLE) / 1000000 / nullif(count(p), 0), 0.0), 6) AS subjectivity
 FROM documents d LEFT JOIN (SELECT doc_id, unnest({sp.word_list('text')}) AS w FROM documents) t ON t.doc_id = d.doc_id
 LEFT JOIN pol ON pol.word = t.w GROUP BY 1)"""
_POL = sp.values("pol", "word, p, s", [(w, float(p), float(s)) for w, (p, s) in sorted(lexicons.polarity_of(_ALL_VALENCE).items())])


@query("sentiment_polarity", sp.query(_POL, select=_POLARITY_SQL))
def _polarity(spark, sf):
    return sentiment.polarity_scores(views.documents_rows(spark, sf), views.polarity(spark))


@query("sentiment_confidence", sp.query(_POL, select=f"SELECT doc_id, true AS supported, label, score, 'polarity' AS method, score AS confidence FROM ({_POLARITY_SQL})"))
def _confidence(spark, sf):
    return sentiment.sentiment_with_fallback(views.documents_rows(spark, sf), None, views.polarity(spark))


@query("l2_normalize", """SELECT vec_id, round(n, 6) AS norm, CAST(i - 1 AS INTEGER) AS dim, round(v[i] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS value FROM (
 SELECT vec_id, v, sqrt(list_sum([x * x for x in v])) AS n, unnest(range(1, len(v) + 1)) AS i FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))""")
def _l2(spark, sf):
    rows = similarity.l2_normalize(spread_small(views.table(spark, sf, "embeddings"), "vec_id"))
    # The outer form keeps Spark from adding a size filter that would compute the array twice.
    return rounded(rows.select("vec_id", "norm", F.posexplode_outer("embedding").alias("dim", "value")))


_EMB_DIM = 64


_EMBED_SQL = f"""w AS (SELECT doc_id, unnest({sp.word_list('text')}) AS w FROM documents),
c AS (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 6))::BIGINT % {_EMB_DIM} AS INTEGER) AS cell,
  sum(CASE WHEN substr(md5(w), 7, 1) IN ('0','1','2','3','4','5','6','7') THEN 1 ELSE -1 END) AS x FROM w GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(CAST(x * x AS DOUBLE))) AS n FROM c GROUP BY 1)"""


@query("embed_documents", f"WITH {_EMBED_SQL} SELECT c.doc_id, cell, round(CAST(x AS DOUBLE) / n, 6) AS value FROM c JOIN n ON n.doc_id = c.doc_id WHERE x <> 0")
def _embed(spark, sf):
    rows = embeddings.embed_documents(views.documents_rows(spark, sf), embeddings.get_backend("hashed-words", dim=_EMB_DIM))
    cells = rows.select("doc_id", F.posexplode_outer("vector").alias("cell", "value"))
    return rounded(cells.filter(F.col("value") != 0.0))


@query("embedding_provenance", f"""WITH {_EMBED_SQL}, v AS (SELECT d.doc_id, list_transform(range({_EMB_DIM}), lambda i: coalesce(list_filter(z, lambda y: y.cell = i)[1].x, 0)) AS cells
  FROM documents d LEFT JOIN (SELECT c.doc_id, list({{'cell': cell, 'x': CAST(x AS DOUBLE) / CASE WHEN n = 0 THEN 1 ELSE n END}}) AS z FROM c JOIN n ON n.doc_id = c.doc_id GROUP BY 1) e ON e.doc_id = d.doc_id)
 SELECT doc_id, 'hashed-words' AS backend, 'md5-{_EMB_DIM}' AS model, {_EMB_DIM} AS dim, true AS normalized, len(cells) = {_EMB_DIM} AS dim_ok,
 abs(sqrt(list_sum(list_transform(cells, lambda x: x * x))) - 1) < 0.001 OR list_sum(list_transform(cells, lambda x: x * x)) = 0 AS norm_ok FROM v""")
def _provenance(spark, sf):
    backend = embeddings.get_backend("hashed-words", dim=_EMB_DIM)
    return embeddings.check_provenance(embeddings.embed_documents(views.documents_rows(spark, sf), backend))


# Documents under their detected language; some in a language without rules. Valid in both SQL dialects.
_NO_RULES = "n_chars % 17 = 0"


def _corpus(spark, sf) -> assemble.Corpus:
    detected = language.detect_language(views.documents_rows(spark, sf).drop("lang"))
    lang = F.when(F.expr(_NO_RULES), "it").otherwise(F.col("language"))
    docs = detected.select("doc_id", "text", "source", lang.alias("lang"), F.round("language_confidence", 6).alias("lang_confidence"))
    return assemble.Corpus(docs, valence=views.valence(spark))


_RELABEL = sp.DETECT + ",\n" + f"""redocs AS (SELECT d.doc_id, d.text, d.source, d.n_chars, CASE WHEN d.{_NO_RULES} THEN 'it' ELSE t.language END AS lang,
 round(t.language_confidence, 6) AS lang_confidence FROM documents d JOIN detected t ON t.doc_id = d.doc_id)"""


def _on_detected(sql: str) -> str:
    return sql.replace("FROM documents", "FROM redocs")


_MODEL_SQL = "CASE lang " + " ".join(f"WHEN {sp.lit(k)} THEN {sp.lit(v)}" for k, v in sorted(lexicons.LANGUAGE_MODELS.items())) + " END"
_HAS_ARCS = f"lang IN {sp.in_list(sorted(lexicons.LANGUAGE_MODELS))}"


def _numbers(name: str, table: str, columns: list[str], confidence: str = "1.0::DOUBLE", prefix: str = "") -> str:
    """One row for each numeric column of a table."""
    cells = ", ".join(f"{{'m': '{prefix}{c}', 'v': CAST({c} AS DOUBLE)}}" for c in columns)
    return f"SELECT doc_id, '{name}' AS name, {confidence} AS confidence, x.m AS metric, x.v AS value, NULL AS text_value FROM (SELECT *, unnest([{cells}]) AS x FROM {table})"


def _rows(name: str, table: str, metric: str, value: str = "NULL", text: str = "NULL", confidence: str = "1.0::DOUBLE") -> str:
    return f"SELECT doc_id, '{name}', {confidence}, {metric}, CAST({value} AS DOUBLE), {text} FROM {table}"


_RESULT_CTES = [
    _RELABEL, _on_detected(sp.ARCS), _on_detected(sp.LEXICAL).removeprefix(_on_detected(sp.SENT) + ",\n"), _on_detected(sp.ENTS), _on_detected(sp.READ), _STANDARD,
    sp.sentiment_ctes("SELECT doc_id, text FROM redocs", _ALL_VALENCE), _COUNTS, _YAKE, _on_detected(_EMBED_SQL),
    "tops AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, lemma) AS rank FROM cnt)",
    "ups AS (SELECT doc_id, upos, count(*) AS c FROM tok GROUP BY 1, 2)", "upr AS (SELECT *, c / sum(c) OVER (PARTITION BY doc_id) AS ratio FROM ups)",
    """upl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, upos ORDER BY c DESC, f) AS rank FROM (SELECT doc_id, upos, lemma, count(*) AS c, min(tok_id) AS f
 FROM tok WHERE is_alpha AND NOT is_stop GROUP BY 1, 2, 3))""",
    "nersum AS (SELECT d.doc_id, count(e.label) AS total_entities, count(e.label) > 0 AS supported FROM redocs d LEFT JOIN ents e ON e.doc_id = d.doc_id GROUP BY 1)",
    "nerc AS (SELECT doc_id, label, count(*) AS c FROM ents GROUP BY 1, 2)", 'nere AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY "start") AS rank FROM ents)',
    "kws AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, keyword) AS rank FROM yh)",
    f"arcd AS (SELECT a.*, h.upos || '->' || a.dep AS arc FROM arcs a JOIN arcs h ON h.doc_id = a.doc_id AND h.tok_id = a.head_id WHERE a.{_HAS_ARCS})",
    "depc AS (SELECT doc_id, dep, count(*) AS c FROM arcd GROUP BY 1, 2)",
    "arcc AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) AS rank FROM (SELECT doc_id, arc, count(*) AS c, min(tok_id) AS f FROM arcd GROUP BY 1, 2))",
    f"parsed AS (SELECT doc_id, {_HAS_ARCS} AS supported FROM redocs)",
    "sentsum AS (SELECT *, abs(compound) AS score FROM senti)",
    f"vec AS (SELECT d.doc_id, i, coalesce(v, 0) AS v FROM redocs d, range({_EMB_DIM}) r(i) LEFT JOIN (SELECT c.doc_id, cell, x / nullif(n, 0) AS v FROM c JOIN n ON n.doc_id = c.doc_id) z ON z.doc_id = d.doc_id AND z.cell = i)"]
_READ_METRICS = [*_GRADES, "flesch_reading_ease", "difficult_words"]
_DEP_CONFIDENCE = "CASE WHEN supported THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END"
_RESULT_UNION = " UNION ALL ".join([
    _numbers("lexical_stats", "lexical", ["total_tokens", "unique_lemmas", "sentences", "avg_token_length", "avg_sentence_length_tokens", "type_token_ratio"]),
    _rows("lexical_stats", "tops WHERE rank <= 20", "concat('top_lemmas[', rank - 1, ']')", "c", "lemma"),
    _rows("pos", "ups", "concat('upos_counts.', upos)", "c"), _rows("pos", "upr", "concat('upos_ratios.', upos)", "ratio"),
    _rows("pos", "upl WHERE rank <= 5", "concat('top_lemmas_by_upos.', upos, '[', rank - 1, ']')", "c", "lemma"),
    _numbers("ner", "nersum", ["supported", "total_entities"]), _rows("ner", "nerc", "concat('counts_by_label.', label)", "c"),
    _rows("ner", "nere WHERE rank <= 10", "concat('examples_by_label.', label, '[', rank - 1, ']')", "NULL", "text"),
    _numbers("readability", "readab", _READ_METRICS), _rows("readability", "readab", "'supported'", "1"), _rows("readability", "readab", "'note'", "NULL", sp.lit(profile.READABILITY_NOTE)),
    _rows("readability", "standard", "'text_standard'", "NULL", "text_standard"),
    _rows("keywords", "redocs", "'method'", "NULL", "'yake'"), _rows("keywords", "kws WHERE rank <= 20", "concat('keywords[', rank - 1, ']')", "score", "keyword"),
    _rows("dependency", "parsed", "'supported'", "CASE WHEN supported THEN 1 ELSE 0 END", confidence=_DEP_CONFIDENCE),
    _rows("dependency", "parsed WHERE NOT supported", "'note'", "NULL", sp.lit(profile.NO_PARSER), confidence="0.8::DOUBLE"),
    _rows("dependency", "depc", "concat('dep_counts.', dep)", "c", confidence="0.9::DOUBLE"),
    _rows("dependency", "arcc WHERE rank <= 20", "concat('head_pos_dep.', arc)", "c", confidence="0.9::DOUBLE"),
    _numbers("sentiment", "sentsum", ["neg", "neu", "pos", "compound"], "score", "scores."), _numbers("sentiment", "sentsum", ["score"], "score"),
    _rows("sentiment", "sentsum", "'supported'", "1", confidence="score"), _rows("sentiment", "sentsum", "'label'", "NULL", _LABEL_SQL, "score"),
    _rows("sentiment", "sentsum", "'method'", "NULL", "'valence'", "score"),
    _rows("embeddings", "redocs", "'supported'", "1"), _rows("embeddings", "redocs", "'backend'", "NULL", "'hashed-words'"),
    _rows("embeddings", "redocs", "'model'", "NULL", f"'md5-{_EMB_DIM}'"), _rows("embeddings", "redocs", "'dim'", str(_EMB_DIM)), _rows("embeddings", "redocs", "'normalized'", "1"),
    _rows("embeddings", "vec", "concat('vector[', i, ']')", "v")])


def _flat(value, path, depth: int = 3):
    """Values of a JSON variant as rows (metric, value, text_value): numbers and booleans, texts, and pairs of a text and a number."""
    kind = schema.kind(value)
    number = F.coalesce(F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "boolean").cast("double"))
    leaf = F.array(F.struct(path.alias("metric"), F.when(kind != "STRING", number).alias("value"), F.when(kind == "STRING", schema.string(value)).alias("text_value")))
    if not depth:
        return leaf
    items = schema.elements(value)
    first, second = F.get(items, F.lit(0)), F.get(items, F.lit(1))
    pair = F.array(F.struct(path.alias("metric"), schema.number(second).alias("value"), schema.string(first).alias("text_value")))
    is_pair = (F.size(items) == 2) & (schema.kind(first) == "STRING") & schema.kind(second).rlike(schema.NUMBER)
    below = F.flatten(F.transform(items, lambda x, i: _flat(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth - 1)))
    inside = F.flatten(F.transform(schema.entries(value), lambda e: _flat(e["value"], F.concat(path, F.lit("."), e["key"]), depth - 1)))
    return F.when(kind.startswith("OBJECT"), inside).when(kind.startswith("ARRAY"), F.when(is_pair, pair).otherwise(below)).otherwise(leaf)


def _metrics(results):
    """All values of a result object."""
    return F.flatten(F.transform(schema.entries(results), lambda e: _flat(e["value"], e["key"])))


@query("analyzer_results", sp.query(*_RESULT_CTES, select=f"""SELECT r.doc_id, name, round(confidence, 6) AS confidence, metric, round(value, 6) AS value, text_value, lang AS language,
 lang_confidence AS language_confidence, {_MODEL_SQL} AS model FROM ({_RESULT_UNION}) r JOIN redocs d ON d.doc_id = r.doc_id"""))
def _results(spark, sf):
    rows = assemble.analyzer_results(_corpus(spark, sf), assemble.available_analyzers())
    return rounded(rows.select("doc_id", "name", "confidence", F.inline(_metrics(F.parse_json("results"))), F.col("language_code").alias("language"),
                               F.col("lang_confidence").alias("language_confidence"), "model"))


@query("analyzer_summary", sp.query(*_RESULT_CTES, select=f"""SELECT r.doc_id, name, round(any_value(confidence), 6) AS confidence, CAST(NULL AS DOUBLE) AS processing_time, any_value(lang) AS metadata_language,
 any_value({_MODEL_SQL}) AS metadata_model, {', '.join(f"CAST(max(value) FILTER (metric = '{m}') AS BIGINT) AS results_{m}" for m in ('total_tokens', 'total_entities', 'dim', 'difficult_words'))},
 {', '.join(f"round(max(value) FILTER (metric = '{m}'), 6) AS results_{m}" for m in ('type_token_ratio', 'smog_index', 'score'))},
 {', '.join(f"max(value) FILTER (metric = '{m}') > 0 AS results_{m}" for m in ('supported', 'normalized'))},
 {', '.join(f"max(text_value) FILTER (metric = '{m}') AS results_{m}" for m in ('label', 'method', 'note', 'text_standard', 'backend'))}
 FROM (SELECT * FROM ({_RESULT_UNION}) UNION ALL SELECT doc_id, 'pos', 1.0, '', NULL, NULL FROM redocs) r JOIN redocs d ON d.doc_id = r.doc_id GROUP BY r.doc_id, name"""))
def _summary(spark, sf):
    rows = assemble.analyzer_summary(_corpus(spark, sf), assemble.available_analyzers())
    return rounded(rows.select(
        "doc_id", "name", "confidence", "processing_time", "metadata_language", "metadata_model",
        *[f"results_{m}" for m in ("total_tokens", "total_entities", "dim", "difficult_words", "type_token_ratio", "smog_index", "score", "supported", "normalized", "label",
                                   "method", "note", "text_standard", "backend")]))


def _payload_job(spark, sf) -> DataFrame:
    corpus = _corpus(spark, sf)
    content = corpus.docs.select(
        "doc_id", F.lit("file").alias("source_type"), F.col("source").alias("source_value"), F.lit("").alias("domain"),
        F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"), *extract.content_counts(F.col("text")))
    return assemble.payloads(corpus, content, assemble.select_analyzers(with_embeddings=True, with_sentiment=True))


@query("payloads")
def _payloads(spark, sf):
    return _payload_job(spark, sf)


@query("payload_values", sp.query(*_RESULT_CTES, select=f"""SELECT d.doc_id, 'textloom' AS tool, source AS source_value, concat('document ', d.doc_id) AS title, CAST(length(text) AS BIGINT) AS char_count,
 CAST(len({sp.blank_words('text')}) AS BIGINT) AS word_count, lang AS code, lang_confidence AS language_confidence, {_MODEL_SQL} AS model, name, round(any_value(confidence), 6) AS confidence,
 0.0::DOUBLE AS processing_time, count(metric) AS metrics, count(text_value) AS texts, CAST(coalesce(sum(CAST(round(value * 1000000) AS BIGINT)), 0) AS BIGINT) AS total,
 string_agg(text_value, '|' ORDER BY metric) FILTER (text_value IS NOT NULL) AS said FROM ({_RESULT_UNION}) r JOIN redocs d ON d.doc_id = r.doc_id
 GROUP BY d.doc_id, text, source, lang, lang_confidence, name"""))
def _payload_values(spark, sf):
    """Payloads written as JSON, parsed again, with every value of every analyzer in the sums."""
    text = lambda path: F.try_variant_get("_d", path, "string")
    rows = _payload_job(spark, sf).select("doc_id", F.parse_json("payload").alias("_d")).select(
        "doc_id", text("$.tool").alias("tool"), text("$.source.value").alias("source_value"), text("$.content.title").alias("title"),
        F.try_variant_get("_d", "$.content.char_count", "bigint").alias("char_count"), F.try_variant_get("_d", "$.content.word_count", "bigint").alias("word_count"),
        text("$.language.code").alias("code"), F.try_variant_get("_d", "$.language.confidence", "double").alias("language_confidence"), text("$.language.model").alias("model"),
        F.explode(schema.elements(schema.member(F.col("_d"), "analyzers"))).alias("_a"))
    rows = rows.select(*[c for c in rows.columns if c != "_a"], schema.string(schema.member(F.col("_a"), "name")).alias("name"),
                       schema.number(schema.member(F.col("_a"), "confidence")).alias("confidence"),
                       schema.number(schema.member(F.col("_a"), "processing_time")).alias("processing_time"), _metrics(schema.member(F.col("_a"), "results")).alias("_m"))
    texts = F.array_sort(F.filter("_m", lambda m: m["text_value"].isNotNull()))
    total = F.aggregate("_m", F.lit(0).cast("long"), lambda acc, m: acc + F.coalesce(F.round(m["value"] * 1_000_000).cast("long"), F.lit(0)))  # in millionths
    rows = rows.select(*[c for c in rows.columns if c != "_m"], F.size("_m").cast("long").alias("metrics"), F.size(texts).cast("long").alias("texts"),
                       total.alias("total"), F.nullif(F.array_join(F.transform(texts, lambda m: m["text_value"]), "|"), F.lit("")).alias("said"))
    return rounded(rows)


def _token_job(spark, sf) -> DataFrame:
    docs = views.documents_rows(spark, sf)
    return assemble.token_json(docs, views.arcs_of(spark, sf), tokens.entities(docs))


@query("token_json")
def _token_json(spark, sf):
    return _token_job(spark, sf)


@query("token_values", sp.query(sp.ARCS, sp.ENTS, """tix AS (SELECT a.*, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY a.doc_id ORDER BY a.tok_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + length(d.text) - length(regexp_replace(d.text, '^\\s+', '')) AS INTEGER) AS char_idx FROM arcs a JOIN documents d ON d.doc_id = a.doc_id)""",
    select="""SELECT t.doc_id, t.sent_id, CAST(t.tok_id AS INTEGER) AS tok_id, t.text, t.lemma, t.upos, t.xpos, t.dep, t.head_id, coalesce(e.label, '') AS ent_type, t.ws, t.char_idx
 FROM tix t LEFT JOIN ents e ON e.doc_id = t.doc_id AND t.tok_id >= e."start" AND t.tok_id < e."end" """))
def _token_values(spark, sf):
    """Token JSON as it is written, read back as a token table."""
    parsed = _token_job(spark, sf).select("doc_id", F.from_json("json", readers.TOKEN_JSON_SCHEMA).alias("_j")).select("doc_id", "_j.*")
    return readers.token_rows(parsed).select("doc_id", "sent_id", "tok_id", "text", "lemma", "upos", "xpos", "dep", "head_id", "ent_type", "ws", "char_idx")


@query("corpus_rollup", sp.query(sp.LEXICAL, select="""SELECT lang, source, count(*) AS documents, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
 CAST(sum(sentences) AS BIGINT) AS sentences FROM lexical JOIN (SELECT doc_id, lang, source FROM documents) d USING (doc_id) GROUP BY ROLLUP (lang, source)"""))
def _rollup(spark, sf):
    docs = views.documents(spark, sf)
    return lexical.corpus_rollup(docs, lexical.lexical_stats(docs))


# ---------------------------------------------------------------- similarity

@query("cosine_pairs", sp.query(sp.PAIRS, select="SELECT left_id, right_id, is_similar, round(score, 6) AS score FROM prs"))
def _cosine(spark, sf):
    rows = similarity.cosine_pairs(views.pairs(spark, sf), views.table(spark, sf, "embeddings"))
    return rounded(rows.select("left_id", "right_id", "is_similar", "score"))


def _scored(spark, sf) -> DataFrame:
    return similarity.cosine_pairs(views.pairs(spark, sf), views.table(spark, sf, "embeddings"))


@query("similarity_verdicts", sp.query(sp.PAIRS, select="""SELECT is_similar, count(*) AS pairs, count(*) FILTER (ok) AS passed, bool_and(ok) AS all_passed
 FROM (SELECT is_similar, CASE WHEN is_similar THEN score >= 0.6 ELSE score <= 0.3 END AS ok FROM prs) GROUP BY 1"""))
def _verdicts(spark, sf):
    return similarity.similarity_verdicts(_scored(spark, sf))


@query("calibrate_threshold", sp.query(sp.PAIRS, select="SELECT round(max(score) FILTER (NOT is_similar), 6) AS max_dissimilar, round(max(score) FILTER (NOT is_similar) + 0.05, 6) AS threshold FROM prs"))
def _calibrate(spark, sf):
    return similarity.calibrate_threshold(_scored(spark, sf))


@query("similarity_ranges", sp.query(sp.PAIRS, select="""SELECT is_similar, CAST(gap AS INTEGER) AS gap, count(*) AS pairs, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score,
 round(avg(score), 6) AS avg_score FROM prs GROUP BY 1, 2"""))
def _ranges(spark, sf):
    return similarity.similarity_ranges(_scored(spark, sf), "gap")


@query("length_progression", sp.query(sp.PAIRS, select="""SELECT is_similar, round(arg_min(score, pair_no), 6) AS first_score, round(arg_max(score, pair_no), 6) AS last_score,
 round(arg_max(score, pair_no) - arg_min(score, pair_no), 6) AS change FROM prs GROUP BY 1"""))
def _progression(spark, sf):
    return similarity.length_progression(_scored(spark, sf), "pair_no")


@query("topk_similar", """WITH cells AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS d FROM embeddings),
q AS (SELECT label AS query_id, list(m ORDER BY d) AS qv FROM (SELECT label, d, round(avg(x), 9) AS m FROM cells GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])), 9) AS score FROM q, embeddings)
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def _topk(spark, sf):
    vectors = views.table(spark, sf, "embeddings")
    queries = similarity.centroids(vectors, "label").select(F.col("label").cast("long").alias("query_id"), "vector")
    corpus = vectors.select("vec_id", F.col("embedding").alias("vector"))
    return rounded(similarity.topk_similar(queries, corpus, 10).select("query_id", "vec_id", "score", "rank"))


@query("cluster_vectors")
def _clusters(spark, sf):
    return clusters.cluster_vectors(spread_small(views.table(spark, sf, "embeddings"), "vec_id"), 10)


_LLOYD_ROUNDS = 3


def _lloyd_sql() -> str:
    """Rounds from the mean vectors of the labels, unrolled: centres in whole billionths, then the nearest one."""
    parts = ["""u AS (SELECT vec_id, label, list_transform(v, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS v FROM (
 SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings))""",
             "a0 AS (SELECT vec_id, v, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster FROM u)"]
    for r in range(_LLOYD_ROUNDS + 1):
        parts.append(f"""c{r} AS (SELECT cluster, list(x ORDER BY d) AS c FROM (SELECT cluster, d, round(CAST(sum(CAST(round(x * 1000000000) AS HUGEINT)) AS DOUBLE) / 1000000000 / count(*), 9) AS x
 FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS d FROM a{r}) GROUP BY 1, 2) GROUP BY 1)""")
        parts.append(f"""a{r + 1} AS (SELECT a.vec_id, any_value(a.v) AS v, arg_min(c.cluster, {{'d': round(greatest(list_sum(list_transform(range(len(a.v)), lambda i: (a.v[i + 1] - c.c[i + 1]) * (a.v[i + 1] - c.c[i + 1]))), 0), 9),
 'k': c.cluster}}) AS cluster FROM a{r} a, c{r} c GROUP BY 1)""")
    return sp.query(*parts, select=f"SELECT vec_id, cluster FROM a{_LLOYD_ROUNDS + 1}")


@query("lloyd_rounds", _lloyd_sql())
def _lloyd(spark, sf):
    vectors = spread_small(views.table(spark, sf, "embeddings"), "vec_id")
    rows = clusters.unit_vectors(vectors, "vec_id", "embedding")
    labelled = clusters.labelled_centers(rows.join(vectors.select(F.col("vec_id").alias("key"), "label"), "key"))
    return clusters.assigned(rows, clusters.lloyd(rows, labelled, _LLOYD_ROUNDS)).select(F.col("key").alias("vec_id"), "cluster")


@query("ivf_recall", "SELECT count(*) AS queries, 10 AS k, true AS recall_ok FROM embeddings WHERE vec_id % 20 = 0")
def _ivf(spark, sf):
    """Share of the exact neighbours that the inverted file finds for every twentieth vector, against all vectors."""
    corpus = spread_small(views.table(spark, sf, "embeddings"), "vec_id").select("vec_id", F.col("embedding").alias("vector"))
    asked = corpus.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    found, exact = clusters.ivf_search(asked, corpus, 10), similarity.topk_similar(asked, corpus, 10)
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.lit(10).alias("k"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recall_ok"))


# ---------------------------------------------------------------- run log

@query("infer_backend", sp.query(sp.RUNLOG, select=f"SELECT pos, {sp.BACKEND} AS backend FROM run_log"))
def _backend(spark, sf):
    log = views.run_log(spark, sf)
    return log.select("pos", runlog.infer_backend(F.col("case"), F.col("analyzers")).alias("backend"))


_SUMMARY_SQL = """SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
 round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(avg(seconds), 6) AS avg_time, min(seconds) AS min_time, max(seconds) AS max_time,
 round(sum(seconds), 4) AS total_time, bool_and(success) AS all_success FROM run_log"""


@query("run_summary", sp.query(sp.RUNLOG, select=_SUMMARY_SQL))
def _run_summary(spark, sf):
    return runlog.run_summary(views.run_log(spark, sf))


@query("run_summary_long", sp.query(sp.RUNLOG, f"s AS ({_SUMMARY_SQL})", select="""UNPIVOT (SELECT total::DOUBLE AS total, successful::DOUBLE AS successful, failed::DOUBLE AS failed, success_rate,
 avg_time, min_time, max_time, total_time FROM s) ON COLUMNS(*) INTO NAME metric VALUE value"""))
def _run_long(spark, sf):
    return runlog.run_summary_long(views.run_log(spark, sf))


@query("run_extremes", sp.query(sp.RUNLOG, "ok AS (SELECT * FROM run_log WHERE success)", select="""SELECT
 (SELECT "case" FROM ok ORDER BY seconds, pos LIMIT 1) AS fastest_case, (SELECT seconds FROM ok ORDER BY seconds, pos LIMIT 1) AS fastest_seconds,
 (SELECT "case" FROM ok ORDER BY seconds DESC, pos LIMIT 1) AS slowest_case, (SELECT seconds FROM ok ORDER BY seconds DESC, pos LIMIT 1) AS slowest_seconds"""))
def _extremes(spark, sf):
    return runlog.run_extremes(views.run_log(spark, sf))


@query("run_by_backend", sp.query(sp.RUNLOG, select=f"""SELECT backend, count(*) AS "count", round(avg(seconds), 6) AS avg_time, round(count(*) FILTER (success) / count(*), 6) AS success_rate
 FROM (SELECT *, {sp.BACKEND} AS backend FROM run_log) WHERE backend IS NOT NULL GROUP BY 1"""))
def _by_backend(spark, sf):
    return runlog.run_by_backend(views.run_log(spark, sf))


@query("run_filter", sp.query(sp.RUNLOG, select=f"""SELECT pos, "case", language, analyzers, seconds, success FROM run_log
 WHERE success AND seconds >= 5.0 AND seconds <= 120.0 AND contains(analyzers, 'embeddings') AND {sp.BACKEND} = 'miniLM'"""))
def _filter(spark, sf):
    rows = runlog.run_filter(views.run_log(spark, sf), success_only=True, min_time=5.0, max_time=120.0, analyzer="embeddings", backend="MINILM")
    return rows.select("pos", "case", "language", "analyzers", "seconds", "success")


@query("run_compare", sp.query(sp.RUNLOG, f"""c AS (SELECT count(*) FILTER (NOT b) AS total_1, count(*) FILTER (b) AS total_2, avg(seconds) FILTER (NOT b) AS a1, avg(seconds) FILTER (b) AS a2,
 count(*) FILTER (NOT b AND success) / count(*) FILTER (NOT b) AS r1, count(*) FILTER (b AND success) / count(*) FILTER (b) AS r2 FROM (SELECT *, ts >= TIMESTAMP '{views.RUN_SPLIT} 00:00:00' AS b FROM run_log))""",
                               select="""SELECT total_1, total_2, round(a1, 6) AS avg_time_1, round(a2, 6) AS avg_time_2, round(r1, 6) AS success_rate_1, round(r2, 6) AS success_rate_2,
 round((a1 - a2) / a1 * 100.0, 4) AS avg_time_improvement, round((r2 - r1) / r1 * 100.0, 4) AS success_rate_improvement FROM c"""))
def _compare(spark, sf):
    return runlog.run_compare(views.run_log(spark, sf), F.col("ts") >= F.lit(f"{views.RUN_SPLIT} 00:00:00").cast("timestamp"))


@query("sla_check", sp.query(sp.RUNLOG, select='SELECT "case", round(avg(seconds), 6) AS avg_time, round(avg(seconds), 6) > 50.0 AS violation FROM run_log GROUP BY 1'))
def _sla(spark, sf):
    return runlog.sla_check(views.run_log(spark, sf), 50.0)


@query("run_gate", sp.query(sp.RUNLOG, f"s AS ({_SUMMARY_SQL})", select="SELECT total, successful AS ok, failed, avg_time, max_time, min_time, all_success AND avg_time < 100.0 AS gate_passed FROM s"))
def _gate(spark, sf):
    return runlog.run_gate(views.run_log(spark, sf), 100.0)


_AN = """an AS (SELECT doc_id, unnest(a) AS a, unnest(range(len(a))) AS i FROM (SELECT doc_id, CAST(json_extract(payload, '$.analyzers') AS JSON[]) AS a FROM pl WHERE json_valid(payload)))"""


@query("analyzer_times", sp.query(sp.PAYLOADS, _AN, select="""SELECT json_extract_string(a, '$.name') AS name, count(*) AS n, round(avg(CAST(json_extract_string(a, '$.processing_time') AS DOUBLE)), 6) AS avg_time,
 round(coalesce(sum(CAST(json_extract_string(a, '$.processing_time') AS DOUBLE)), 0), 6) AS total_time FROM an GROUP BY 1"""))
def _times(spark, sf):
    rows = quality.analyzer_rows(views.payload_rows(spark, sf))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("processing_time"), 6).alias("avg_time"),
                                    F.round(F.coalesce(F.sum("processing_time"), F.lit(0.0)), 6).alias("total_time"))


# ---------------------------------------------------------------- quality

def _json_rule(test: str, path: str, rule: str) -> str:
    return f"CASE WHEN coalesce({test}, false) THEN {{'path': {path}, 'rule': '{rule}'}} END"


def _json_rules(doc: str, shown: str) -> dict[str, str]:
    num = "('UBIGINT','BIGINT','DOUBLE','HUGEINT','UHUGEINT')"
    t = lambda p: f"json_type({doc}, '$.{p}')"
    v = lambda p: f"TRY_CAST(json_extract_string({doc}, '$.{p}') AS DOUBLE)"
    return {"t": t, "v": v, "num": num}


def _violations_sql() -> str:
    r = _json_rules("payload", "")
    t, v, num = r["t"], r["v"], r["num"]
    path = lambda p: f"'{p}'"
    rules = [_json_rule(f"{t(p)} IS NULL", path(p), "required") for p in ("tool", "version", "language", "analyzers")]
    rules.append(_json_rule(f"{t('tool')} IS NOT NULL AND coalesce(json_extract_string(payload, '$.tool'), '') <> 'textloom'", path("tool"), "const"))
    rules += [_json_rule(f"{t('language')} = 'OBJECT' AND {t('language.' + p)} IS NULL", path("language." + p), "required") for p in ("code", "confidence", "model")]
    rules += [_json_rule(f"{t(p)} <> 'VARCHAR'", path(p), "type") for p in ("version", "language.code", "language.model", "source.value", "source.domain", "content.title")]
    rules += [_json_rule(f"{t('source.type')} IS NOT NULL AND json_extract_string(payload, '$.source.type') NOT IN ('url','file','stdin')", path("source.type"), "enum")]
    rules += [_json_rule(f"{t('language.confidence')} NOT IN {num}", path("language.confidence"), "type"),
              _json_rule(f"{v('language.confidence')} < 0", path("language.confidence"), "minimum"),
              _json_rule(f"{v('language.confidence')} > 1", path("language.confidence"), "maximum")]
    for p in ("content.char_count", "content.word_count"):
        rules += [_json_rule(f"{t(p)} NOT IN ('UBIGINT','BIGINT')", path(p), "type"), _json_rule(f"{v(p)} < 0", path(p), "minimum")]
    a = _json_rules("a", "")
    at, av = a["t"], a["v"]
    ap = lambda p: f"concat('analyzers[', i, '].{p}')"
    arules = [_json_rule(f"{at(p)} IS NULL", ap(p), "required") for p in ("name", "processing_time", "confidence", "results")]
    arules += [_json_rule(f"{at('name')} IS NOT NULL AND json_extract_string(a, '$.name') NOT IN {sp.in_list(quality.ANALYZER_NAMES)}", ap("name"), "enum"),
               _json_rule(f"{av('processing_time')} < 0", ap("processing_time"), "minimum"),
               _json_rule(f"{av('confidence')} < 0", ap("confidence"), "minimum"), _json_rule(f"{av('confidence')} > 1", ap("confidence"), "maximum")]
    return f"""viol AS (SELECT doc_id, v.path AS path, v.rule AS rule FROM (
  SELECT doc_id, unnest([x for x in [{', '.join(rules)}] if x is not null]) AS v FROM pl WHERE json_valid(payload)
  UNION ALL SELECT doc_id, unnest([x for x in [{', '.join(arules)}] if x is not null]) AS v FROM an
  UNION ALL SELECT doc_id, {{'path': concat('analyzers[', i, '].results'), 'rule': 'oneOf'}} AS v FROM shapes WHERE matching_shapes <> 1
  UNION ALL SELECT doc_id, {{'path': '', 'rule': 'json'}} AS v FROM pl WHERE NOT json_valid(payload)))"""


_SHAPE_HITS = " + ".join(
    "CASE WHEN " + " AND ".join(f"json_type(a, '$.results.{k}') IS NOT NULL" for k in keys) + " THEN 1 ELSE 0 END" for keys in quality.RESULT_KEYS.values())
_SHAPES = f"shapes AS (SELECT doc_id, CAST(i AS INTEGER) AS i, json_extract_string(a, '$.name') AS name, {_SHAPE_HITS} AS matching_shapes FROM an)"


@query("validate_payloads", sp.query(sp.PAYLOADS, _AN, _SHAPES, _violations_sql(), select="SELECT doc_id, path, rule FROM viol"))
def _violations(spark, sf):
    return quality.payload_violations(views.payload_rows(spark, sf))


@query("validate_results_shape", sp.query(sp.PAYLOADS, _AN, _SHAPES, select="SELECT doc_id, i, name, matching_shapes, matching_shapes = 1 AS shape_ok FROM shapes"))
def _shapes(spark, sf):
    return quality.result_shapes(quality.analyzer_rows(views.payload_rows(spark, sf)))


@query("malformed_payloads", sp.query(sp.PAYLOADS, select="SELECT doc_id, 'Invalid JSON' AS error FROM pl WHERE NOT json_valid(payload)"))
def _malformed(spark, sf):
    return quality.malformed(views.payload_rows(spark, sf))


_REPORT = """rep AS (SELECT pl.doc_id, coalesce(e.n, 0) AS errors, coalesce(e.said, '') AS error_list FROM pl LEFT JOIN (SELECT doc_id, count(*) AS n,
 string_agg(CASE WHEN path = '' THEN rule ELSE concat(path, ' ', rule) END, '; ' ORDER BY path, rule) AS said FROM viol GROUP BY 1) e ON e.doc_id = pl.doc_id)"""


@query("validation_report", sp.query(sp.PAYLOADS, _AN, _SHAPES, _violations_sql(), _REPORT,
                                     "names AS (SELECT doc_id, count(*) AS n, string_agg(json_extract_string(a, '$.name'), ',' ORDER BY i) AS names FROM an GROUP BY 1)",
                                     select="""SELECT rep.doc_id, errors = 0 AS valid, errors, error_list, CASE WHEN errors = 0 THEN n ELSE 0 END AS analyzer_count,
 CASE WHEN errors = 0 THEN names ELSE '' END AS analyzers FROM rep LEFT JOIN names ON names.doc_id = rep.doc_id"""))
def _report(spark, sf):
    return quality.validation_report(views.payload_rows(spark, sf))


@query("validation_totals", sp.query(sp.PAYLOADS, _AN, _SHAPES, _violations_sql(), _REPORT,
                                     select="SELECT count(*) AS total, count(*) FILTER (errors = 0) AS valid_files, count(*) FILTER (errors > 0) AS invalid_files FROM rep"))
def _totals(spark, sf):
    return quality.validation_totals(quality.validation_report(views.payload_rows(spark, sf)))


# The language of an older snapshot. Valid in both SQL dialects.
_GOLDEN_LANG = "CASE WHEN n_chars % 31 = 0 THEN upper(lang) ELSE lang END"


@query("golden_diff", sp.query(
    sp.DETECT, "a AS (SELECT doc_id, language, round(CAST(ln AS DOUBLE) / 3, 6) AS third FROM detected)",
    f"g AS (SELECT doc_id, {_GOLDEN_LANG} AS language, round(n_chars / 3, 6) AS third FROM documents)",
    select="SELECT *, 'actual' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM g) UNION ALL SELECT *, 'golden' AS side FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM a)"))
def _golden(spark, sf):
    docs = views.documents_rows(spark, sf)
    actual = language.detect_language(docs).select("doc_id", "language", (F.length(tx.strip(F.col("text"))) / 3.0).alias("third"), F.lit(1.0).alias("fetched_at"))
    golden = docs.select("doc_id", F.expr(_GOLDEN_LANG).alias("language"), (F.col("n_chars") / 3.0).alias("third"), F.lit(2.0).alias("fetched_at"))
    return quality.golden_diff(actual, golden, volatile=("fetched_at",))


@query("analyzer_coverage", sp.query(sp.PAYLOADS, _AN, sp.values("req", "pos, name", list(enumerate(views.REQUIRED_ANALYZERS))),
                                     "miss AS (SELECT pl.doc_id, string_agg(r.name, ',' ORDER BY r.pos) AS missing FROM pl CROSS JOIN req r LEFT JOIN an ON an.doc_id = pl.doc_id AND json_extract_string(an.a, '$.name') = r.name WHERE an.a IS NULL GROUP BY 1)",
                                     select="SELECT pl.doc_id, missing IS NULL AS passed, coalesce(missing, '') AS missing FROM pl LEFT JOIN miss ON miss.doc_id = pl.doc_id"))
def _coverage(spark, sf):
    return quality.analyzer_coverage(views.payload_rows(spark, sf), views.REQUIRED_ANALYZERS)


# ---------------------------------------------------------------- streams

@query("stream_documents", sp.query(sp.DETECT, sp.READ, select=f"""SELECT d.doc_id, d.language, round(d.language_confidence, 6) AS language_confidence, CAST(length(x.text) AS BIGINT) AS char_count,
 CAST(len({sp.blank_words('x.text')}) AS BIGINT) AS word_count, r.flesch_reading_ease, r.flesch_kincaid_grade FROM detected d JOIN documents x ON x.doc_id = d.doc_id JOIN readab r ON r.doc_id = d.doc_id"""))
def _stream_docs(spark, sf):
    return rounded(jobs.stream_documents(spark, f"{sf}/documents*.parquet"))


@query("stream_run_monitor", """SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS runs, round(avg(value), 4) AS avg_seconds, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate
 FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _stream_monitor(spark, sf):
    return jobs.stream_run_monitor(spark, f"{sf}/events*.parquet")


@query("stream_run_monitor_sliding", """SELECT w AS window_start, count(*) AS runs, round(avg(value), 4) AS avg_seconds, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate
 FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts) - i * INTERVAL 6 HOUR for i in range(4)]) AS w FROM events) GROUP BY 1 HAVING w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _stream_sliding(spark, sf):
    return jobs.stream_run_monitor(spark, f"{sf}/events*.parquet", slide="6 hours")


@query("stream_host_sessions", """WITH v AS (SELECT concat('u', user_id, '.example.org') AS host, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM v)
SELECT host, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS visits FROM s GROUP BY host, n
 HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _stream_sessions(spark, sf):
    return jobs.stream_host_sessions(spark, f"{sf}/events*.parquet")


# A request starts when it is made, or some spacing behind the one before: the greatest of all times so far, each moved on by the requests since.
@query("stream_crawl_pacing", """SELECT event_id, host, make_timestamp(us) AS start_ts, round((us - epoch_us(ts)) / 1e6, 3) AS waited_s FROM (
 SELECT *, i * 600000000 + max(epoch_us(ts) - i * 600000000) OVER (PARTITION BY host ORDER BY i ROWS UNBOUNDED PRECEDING) AS us FROM (
  SELECT event_id, concat('u', user_id, '.example.org') AS host, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events))""")
def _stream_pacing(spark, sf):
    return jobs.stream_crawl_pacing(spark, f"{sf}/events*.parquet")


@query("stream_dedup_urls", "SELECT DISTINCT url FROM pages")
def _stream_dedup(spark, sf):
    return jobs.stream_dedup_urls(spark, f"{sf}/pages*.parquet")
