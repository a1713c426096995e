"""Building blocks of the check SQL: the declared rules written once more as common table expressions."""

from __future__ import annotations

from textloom import lexicons
from textloom.functions import text as tx
from textloom.operators import language as lg
from textloom.operators import tokens as tk
from textloom.plans import views


def lit(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def in_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def sentence_list(text: str) -> str:
    return (f"[x for x in string_split(regexp_replace(regexp_replace({text}, '^\\s+', ''), "
            f"'{tx.SENTENCE_END}', '\\1' || chr(30), 'g'), chr(30)) if regexp_matches(x, '\\S')]")


def word_list(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{tx.WORD}')"


def blank_words(text: str) -> str:
    return f"[x for x in regexp_split_to_array({text}, '\\s+') if x <> '']"


def syllables(word: str) -> str:
    return f"greatest(1, len(regexp_extract_all(lower({word}), '[{tx.VOWELS}]+')))"


SENT = f"""sent0 AS (SELECT doc_id, lang, {sentence_list('text')} AS ss FROM documents),
sent AS (SELECT doc_id, lang, unnest(ss) AS s, CAST(unnest(range(len(ss))) AS INTEGER) AS sent_id FROM sent0)"""

LEX = values("lex", "lang, word, is_stop, lemma, upos", lexicons.lexicon_rows())

STOPS = values("stops", "lang, word", [(c, w) for c in sorted(lexicons.FUNCTION_WORDS) for w in lexicons.stop_words(c)])

_SUFFIX_CASES = " ".join(
    f"WHEN lang = '{code}' AND ({' OR '.join(f'''ends_with(lower, '{e}')''' for e in ends)}) THEN '{upos}'"
    for code, upos, ends in lexicons.UPOS_SUFFIXES)

RAW_TOK = SENT + f""",
tok0 AS (SELECT doc_id, lang, sent_id, regexp_extract_all(s, '{tx.TOKEN_WITH_SPACE}') AS p FROM sent),
tok1 AS (SELECT doc_id, lang, sent_id, unnest(p) AS piece, unnest(range(len(p))) AS sent_pos FROM tok0),
tok2 AS (SELECT *, rtrim(piece, {BLANKS}) AS text FROM tok1),
tok3 AS (SELECT *, lower(text) AS lower, CASE WHEN length(piece) > length(text) THEN ' ' ELSE '' END AS ws,
   regexp_matches(substr(text, 1, 1), '\\p{{L}}') AS is_alpha,
   row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, sent_pos) - 1 AS tok_id FROM tok2)"""

TOK = RAW_TOK + ",\n" + LEX + f""",
tok4 AS (SELECT t.*, coalesce(x.is_stop, false) AS is_stop, lower(coalesce(nullif(x.lemma, ''), t.text)) AS lemma, x.upos AS listed
  FROM tok3 t LEFT JOIN lex x ON x.lang = t.lang AND x.word = t.lower),
tok5 AS (SELECT *, coalesce(listed,
   CASE WHEN is_alpha THEN
     CASE WHEN regexp_matches(substr(text, 1, 1), '\\p{{Lu}}') AND sent_pos > 0 THEN CASE WHEN lang = 'de' THEN 'NOUN' ELSE 'PROPN' END
       {_SUFFIX_CASES} ELSE 'NOUN' END
   WHEN regexp_matches(substr(text, 1, 1), '\\p{{N}}') THEN 'NUM'
   WHEN text IN {in_list(lexicons.PUNCTUATION)} THEN 'PUNCT' ELSE 'SYM' END) AS upos FROM tok4),
tok AS (SELECT *, CASE WHEN upos = 'PUNCT' THEN text ELSE upos END AS xpos,
   CASE WHEN upos = 'NUM' THEN 'NumType=Card' WHEN text = '.' THEN 'PunctType=Peri' WHEN text = ',' THEN 'PunctType=Comm'
        WHEN upos = 'PRON' AND is_alpha THEN 'Case=Nom|PronType=Prs' ELSE '' END AS morph FROM tok5)"""

_CONTENT = f"upos IN {in_list(tk.CONTENT_UPOS)}"

ARCS = TOK + f""",
arc0 AS (SELECT *, {_CONTENT} AS is_content,
   coalesce(min(CASE WHEN upos IN ('VERB','AUX') THEN tok_id END) OVER s, min(CASE WHEN {_CONTENT} THEN tok_id END) OVER s, min(tok_id) OVER s) AS root,
   max(CASE WHEN {_CONTENT} THEN tok_id END) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
   min(CASE WHEN {_CONTENT} THEN tok_id END) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next,
   lag(upos) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id) AS lft
   FROM tok WINDOW s AS (PARTITION BY doc_id, sent_id)),
arcs AS (SELECT *, CASE WHEN tok_id = root THEN 'ROOT' WHEN upos = 'ADP' THEN 'prep' WHEN is_content AND lft = 'ADP' THEN 'pobj'
     WHEN is_content AND lft = 'AUX' AND tok_id - 1 = root THEN 'attr'
     WHEN upos = 'DET' THEN 'det' WHEN upos = 'AUX' THEN 'aux' WHEN upos = 'PRON' THEN 'nsubj' WHEN upos = 'CCONJ' THEN 'cc'
     WHEN upos = 'SCONJ' THEN 'mark' WHEN upos = 'PUNCT' THEN 'punct' WHEN upos = 'ADJ' THEN 'amod' WHEN upos = 'ADV' THEN 'advmod'
     WHEN upos = 'NUM' THEN 'nummod' WHEN upos = 'VERB' THEN 'conj'
     WHEN upos IN ('NOUN','PROPN') THEN CASE WHEN tok_id > root THEN 'dobj' ELSE 'nsubj' END ELSE 'dep' END AS dep,
   CAST(CASE WHEN tok_id = root THEN tok_id WHEN upos = 'ADP' THEN coalesce(prev, root) WHEN is_content AND lft = 'ADP' THEN tok_id - 1
     WHEN is_content AND lft = 'AUX' AND tok_id - 1 = root THEN root
     WHEN upos IN ('DET','AUX','PRON','CCONJ','SCONJ','PART') THEN coalesce(next, root)
     WHEN upos IN ('NOUN','PROPN','VERB') THEN root ELSE coalesce(prev, root) END AS INTEGER) AS head_id FROM arc0)"""

_NOMINAL = "('NOUN','PROPN','PRON','ADJ','NUM')"

UD = values("ud", "dep, rel", lexicons.UD_RELATIONS.items())


def tree_ctes(p: str = "") -> str:
    """Numbered trees from the arcs in ``{p}arcs``, as ``{p}tree``."""
    return f"""{p}tr0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id) AS idx FROM {p}arcs),
{p}tr1 AS (SELECT t.*, h.idx AS h_idx, h.sent_id AS h_sent, h.upos AS h_upos, h.head_id AS g_id, g.idx AS g_idx, g.sent_id AS g_sent, g.upos AS g_upos,
    coalesce(ud.rel, lower(t.dep)) AS rel
  FROM {p}tr0 t LEFT JOIN {p}tr0 h ON h.doc_id = t.doc_id AND h.tok_id = t.head_id
  LEFT JOIN {p}tr0 g ON g.doc_id = t.doc_id AND g.tok_id = h.head_id LEFT JOIN ud ON ud.dep = t.dep),
{p}basic AS (SELECT *, CASE WHEN dep = 'ROOT' THEN 0 WHEN h_sent = sent_id THEN h_idx ELSE 0 END AS head_basic,
   CASE WHEN rel = 'obl' AND (CASE WHEN h_upos = 'ADP' THEN g_upos IN {_NOMINAL} ELSE h_upos IN {_NOMINAL} END) THEN 'nmod' ELSE rel END AS deprel_basic,
   coalesce(dep = 'pobj' AND h_upos = 'ADP' AND g_id <> head_id AND h_sent = sent_id AND g_sent = sent_id, false) AS moves FROM {p}tr1),
{p}claims AS (SELECT doc_id, head_id AS tok_id, max(idx) AS noun FROM {p}basic WHERE moves GROUP BY 1, 2),
{p}pp AS (SELECT b.*, CASE WHEN noun IS NOT NULL AND (NOT moves OR noun > idx) THEN noun WHEN moves THEN g_idx ELSE head_basic END AS head_pp,
   CASE WHEN noun IS NOT NULL AND (NOT moves OR noun > idx) THEN 'case' WHEN moves THEN 'nmod' ELSE deprel_basic END AS deprel_pp
  FROM {p}basic b LEFT JOIN {p}claims c ON c.doc_id = b.doc_id AND c.tok_id = b.tok_id),
{p}roots AS (SELECT doc_id, sent_id, min(idx) AS r_idx, arg_min(tok_id, idx) AS r_tok, arg_min(upos, idx) AS r_upos FROM {p}pp WHERE dep = 'ROOT' GROUP BY 1, 2),
{p}attrs AS (SELECT p.doc_id, p.sent_id, min(p.idx) AS a_idx FROM {p}pp p JOIN {p}roots r ON r.doc_id = p.doc_id AND r.sent_id = p.sent_id
  WHERE p.dep = 'attr' AND p.head_id = r.r_tok AND r.r_upos IN ('AUX','VERB') GROUP BY 1, 2),
{p}tree AS (SELECT p.*, CASE WHEN a_idx IS NULL THEN head_pp WHEN idx = a_idx THEN 0 WHEN idx = r_idx THEN a_idx WHEN head_pp = r_idx THEN a_idx ELSE head_pp END AS head_idx,
   CASE WHEN idx = a_idx THEN 'root' WHEN a_idx IS NOT NULL AND idx = r_idx THEN 'cop' ELSE deprel_pp END AS deprel
  FROM {p}pp p LEFT JOIN {p}roots r ON r.doc_id = p.doc_id AND r.sent_id = p.sent_id LEFT JOIN {p}attrs a ON a.doc_id = p.doc_id AND a.sent_id = p.sent_id)"""


TREE = ARCS + ",\n" + UD + ",\n" + tree_ctes()

#: Arcs of another annotator, see ``views.annotated_tokens``.
FOREIGN_ARCS = """x_arcs AS (SELECT * REPLACE (CASE WHEN tok_id = last THEN 'ROOT' WHEN upos = 'ADP' THEN 'prep' WHEN lft = 'ADP' THEN 'pobj' ELSE upos END AS dep,
   CASE WHEN tok_id = last OR upos = 'ADP' THEN last WHEN lft = 'ADP' THEN tok_id - 1 ELSE tok_id + 1 END AS head_id)
  FROM (SELECT *, '' AS dep, 0 AS head_id, max(tok_id) OVER (PARTITION BY doc_id, sent_id) AS last, lag(upos) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id) AS lft FROM tok))"""


def conllu_field(c: str) -> str:
    t = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {t} = '' THEN '_' ELSE translate({t}, chr(9) || chr(10) || chr(13), '   ') END"


CONLLU_FEATS = ("coalesce(nullif(array_to_string([x for x in string_split(morph, '|') if contains(x, '=') and "
                "split_part(x, '=', 1) not in ('PunctType', 'PunctSide')], '|'), ''), '_')")

TOKEN_LINE = ("concat_ws(chr(9), idx, " + conllu_field("text") + ", " + conllu_field("lemma") + ", upos, xpos, "
              + CONLLU_FEATS + ", head_idx, deprel, '_', CASE WHEN ws = '' THEN 'SpaceAfter=No' ELSE '_' END)")

_ENT_BRANCHES = [p for _, p in lexicons.ENTITY_PATTERNS] + [lexicons.MIXED_WORD_PATTERN, lexicons.NUMBER_PATTERN, r"[^\s\p{L}\p{N}]"]
_ENT_LABELS = " ".join(f"WHEN regexp_full_match(t, {lit(p)}) THEN '{n}'" for n, p in lexicons.ENTITY_PATTERNS)


def _phrase(pieces: str) -> str:
    return f"trim(regexp_replace(array_to_string({pieces}, ''), '\\s+', ' ', 'g'))"


ENTS = values("gaz0", "name, label", sorted(lexicons.GAZETTEER.items())) + f""",
gaz AS (SELECT {_phrase('p')} AS key, rtrim(p[1], {BLANKS}) AS first, len(p) AS n, min(label) AS label
  FROM (SELECT regexp_extract_all(lower(name), '{tx.TOKEN_WITH_SPACE}') AS p, label FROM gaz0) GROUP BY ALL),
ch0 AS (SELECT doc_id, regexp_extract_all(text, {lit('|'.join(_ENT_BRANCHES))}) AS c FROM documents),
ch1 AS (SELECT doc_id, unnest(c) AS t, unnest(range(len(c))) AS i FROM ch0),
ch2 AS (SELECT *, len(regexp_extract_all(t, '{tx.TOKEN}')) AS n FROM ch1),
ch3 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ch2),
np0 AS (SELECT doc_id, regexp_extract_all(text, '{tx.TOKEN_WITH_SPACE}') AS p FROM documents),
np1 AS (SELECT doc_id, p, unnest(list_filter(range(len(p)), lambda i: lower(rtrim(p[i + 1], {BLANKS})) IN {in_list(sorted({n.split()[0] for n in lexicons.GAZETTEER}))})) AS i FROM np0),
np2 AS (SELECT doc_id, i, n, {_phrase('p[i + 1:i + n]')} AS text FROM np1, (SELECT DISTINCT n FROM gaz) WHERE i + n <= len(p)),
cand AS (SELECT doc_id, CAST(start AS INTEGER) AS "start", CAST(start + n AS INTEGER) AS "end", label, t AS text, CASE WHEN label = 'CARDINAL' THEN 2 ELSE 0 END AS kind
  FROM (SELECT *, CASE {_ENT_LABELS} WHEN regexp_full_match(t, '{lexicons.NUMBER_PATTERN}') THEN 'CARDINAL' END AS label FROM ch3) WHERE label IS NOT NULL
  UNION ALL SELECT doc_id, CAST(i AS INTEGER), CAST(i + np2.n AS INTEGER), label, text, 1 FROM np2 JOIN gaz ON key = lower(text) AND gaz.n = np2.n),
run0 AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", kind, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cand),
run1 AS (SELECT *, sum(CASE WHEN "start" < reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY "start", kind, "end" DESC ROWS UNBOUNDED PRECEDING) AS run FROM run0),
run2 AS (SELECT doc_id, list([{{'s': "start", 'e': "end", 'l': label, 't': text}}] ORDER BY "start", kind, "end" DESC) AS c FROM run1 GROUP BY doc_id, run),
ents AS (SELECT doc_id, x.s AS "start", x.e AS "end", x.l AS label, x.t AS text
  FROM (SELECT doc_id, unnest(list_reduce(c, lambda k, x: CASE WHEN x[1].s >= k[len(k)].e THEN list_concat(k, x) ELSE k END)) AS x FROM run2))"""

LEXICAL = SENT + ",\n" + STOPS + ",\n" + values("lem", "lang, word, lemma", lexicons.lemma_pairs()) + f""",
w0 AS (SELECT doc_id, lang, unnest({word_list('text')}) AS w FROM documents),
w1 AS (SELECT w0.doc_id, w, s.word IS NULL AS is_content, coalesce(m.lemma, w) AS lemma FROM w0
  LEFT JOIN stops s ON s.lang = w0.lang AND s.word = w LEFT JOIN lem m ON m.lang = w0.lang AND m.word = w),
wa AS (SELECT doc_id, count(*) AS alpha, count(*) FILTER (is_content) AS n, count(DISTINCT lemma) FILTER (is_content) AS u,
  sum(length(w)) FILTER (is_content) AS chars FROM w1 GROUP BY 1),
sa AS (SELECT doc_id, len(ss) AS sentences FROM sent0),
lexical AS (SELECT sa.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS total_tokens, CAST(coalesce(u, 0) AS BIGINT) AS unique_lemmas,
  CAST(sentences AS BIGINT) AS sentences,
  round(coalesce(chars / nullif(n, 0), 0.0), 6) AS avg_token_length,
  round(coalesce(coalesce(alpha, 0) / nullif(sentences, 0), 0.0), 6) AS avg_sentence_length_tokens,
  round(coalesce(u / nullif(n, 0), 0.0), 6) AS type_token_ratio FROM sa LEFT JOIN wa ON wa.doc_id = sa.doc_id)"""

def _slots(text: str) -> str:
    """List of the trigram slots of a text; ``text`` is a column."""
    letters = f"' ' || trim(regexp_replace(regexp_replace(lower({text}), '[^\\p{{Latin}}\\P{{L}}]', '#', 'g'), '[^\\p{{L}}#]+', ' ', 'g')) || ' '"
    mixed = " + ".join(f"unicode(c[i + {k}]) * {m}::BIGINT" for k, m in enumerate(lg.MIX))
    return f"list_transform([string_split({letters}, '')], lambda c: list_transform(range(1, len(c) - 1), lambda i: ({mixed}) % {lg.SLOTS}))[1]"


#: Profiles are learned here once more, from the same sample texts.
DETECT = values("samples", "code, text", lg.default_samples()) + f""",
pro0 AS (SELECT code, unnest({_slots('text')}) AS slot FROM samples),
pro1 AS (SELECT code, count(*) + {lg.PRIOR * lg.SLOTS}::DOUBLE AS total FROM pro0 GROUP BY 1),
pro2 AS (SELECT code, CAST(round(1000 * ln({lg.PRIOR}::DOUBLE / total)) AS BIGINT) AS w0 FROM pro1),
prof AS (SELECT code, slot, CAST(round(1000 * ln((n + {lg.PRIOR}::DOUBLE) / total)) AS BIGINT) - w0 AS w FROM (SELECT code, slot, count(*) AS n FROM pro0 GROUP BY 1, 2) JOIN pro1 USING (code) JOIN pro2 USING (code)),
det0 AS (SELECT doc_id, lang, n_chars, source, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS ln, NOT regexp_matches(text, '\\p{{L}}') AS no_letters, {_slots('text')} AS slots FROM documents),
det1 AS (SELECT doc_id, slot, count(*) AS n FROM (SELECT doc_id, unnest(slots) AS slot FROM det0) GROUP BY 1, 2),
det2 AS (SELECT d.doc_id, d.lang, n_chars, source, ln, no_letters, len(slots) AS grams, pro2.code, len(slots) * w0 + coalesce(v, 0) AS score FROM det0 d CROSS JOIN pro2
  LEFT JOIN (SELECT doc_id, code, sum(n * w) AS v FROM det1 JOIN prof USING (slot) GROUP BY 1, 2) s ON s.doc_id = d.doc_id AND s.code = pro2.code),
det3 AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) AS place FROM det2),
det4 AS (SELECT doc_id, any_value(lang) AS lang, any_value(n_chars) AS n_chars, any_value(source) AS source, any_value(ln) AS ln, any_value(no_letters) AS no_letters,
   max(code) FILTER (place = 1) AS code, 1 / sum(exp((score - best) * (least(1.0::DOUBLE, {lg.EVIDENCE}::DOUBLE / greatest(1, grams)) / 1000))) AS share FROM det3 GROUP BY doc_id),
det5 AS (SELECT *, code IN {in_list(sorted(lexicons.LANGUAGE_MODELS))} AS known, CASE WHEN ln < 200 THEN share * 0.8 ELSE share END AS conf FROM det4),
detected AS (SELECT doc_id, lang, n_chars, source, ln, CASE WHEN no_letters OR NOT known THEN 'en' ELSE code END AS language,
   CASE WHEN ln = 0 THEN 0.0::DOUBLE WHEN no_letters THEN 0.3 WHEN known THEN conf ELSE least(conf, 0.6) END AS language_confidence FROM det5)"""

_SAMPLE = f"array_to_string(({blank_words('text')})[1:100], ' ')"

READ = f"""rd0 AS (SELECT doc_id, {word_list('text')} AS ws, greatest(1, len({sentence_list('text')})) AS s, {_SAMPLE} AS sample FROM documents),
rd1 AS (SELECT doc_id, s, ws, [{syllables('x')} for x in ws] AS sy, [{syllables('x')} for x in {word_list('sample')}] AS ssy,
   greatest(1, len({sentence_list('sample')})) AS ss FROM rd0),
rd2 AS (SELECT doc_id, CAST(s AS DOUBLE) AS s, CAST(len(ws) AS DOUBLE) AS w, CAST(length(array_to_string(ws, '')) AS DOUBLE) AS c,
   CAST(coalesce(list_sum(sy), 0) AS DOUBLE) AS y, CAST(len([x for x in sy if x >= 3]) AS DOUBLE) AS p,
   len(list_distinct([x for x in ws if x not in {in_list(lexicons.EASY_WORDS)} and {syllables('x')} >= 2])) AS d,
   CAST(len(ssy) AS DOUBLE) AS sw, CAST(len([x for x in ssy if x >= 3]) AS DOUBLE) AS sh, CAST(ss AS DOUBLE) AS ss FROM rd1),
rd3 AS (SELECT *, w / s AS wps, coalesce(y / nullif(w, 0), 0) AS spw, coalesce(c / nullif(w, 0), 0) AS lpw, coalesce(s / nullif(w, 0), 0) AS sp,
   coalesce(d / nullif(w, 0), 0) * 100.0::DOUBLE AS hp, p / s AS pp, (sw - sh + sh * 3) / ss AS lin FROM rd2),
rd4 AS (SELECT doc_id, CAST(w AS BIGINT) AS words, CAST(y AS BIGINT) AS syllables, CAST(d AS BIGINT) AS difficult_words,
   206.835::DOUBLE - 1.015::DOUBLE * wps - 84.6::DOUBLE * spw AS f1, 0.39::DOUBLE * wps + 11.8::DOUBLE * spw - 15.59::DOUBLE AS f2,
   CASE WHEN s >= 3 THEN 1.043::DOUBLE * sqrt(30.0::DOUBLE * pp) + 3.1291::DOUBLE ELSE 0.0 END AS f3,
   4.71::DOUBLE * lpw + 0.5::DOUBLE * wps - 21.43::DOUBLE AS f4,
   0.0588::DOUBLE * (lpw * 100.0::DOUBLE) - 0.296::DOUBLE * (sp * 100.0::DOUBLE) - 15.8::DOUBLE AS f5,
   CASE WHEN lin > 20 THEN lin / 2.0::DOUBLE ELSE lin / 2.0::DOUBLE - 1.0::DOUBLE END AS f6,
   0.1579::DOUBLE * hp + 0.0496::DOUBLE * wps + CASE WHEN hp > 5 THEN 3.6365::DOUBLE ELSE 0.0::DOUBLE END AS f7 FROM rd3),
readab AS (SELECT doc_id, words, syllables, difficult_words,
   {', '.join(f'round(CASE WHEN words > 0 THEN f{i} ELSE 0.0::DOUBLE END, 6) AS {n}' for i, n in enumerate(
       ['flesch_reading_ease', 'flesch_kincaid_grade', 'smog_index', 'automated_readability_index', 'coleman_liau_index',
        'linsear_write_formula', 'dale_chall_readability_score'], 1))} FROM rd4)"""

RUNLOG = f"run_log AS ({views.RUN_LOG_SQL})"
BACKEND = """CASE WHEN lower("case") LIKE '%bge\\_m3%' ESCAPE '\\' OR lower("case") LIKE '%bge-m3%' THEN 'bge-m3'
 WHEN lower("case") LIKE '%openai\\_te3%' ESCAPE '\\' OR lower("case") LIKE '%openai-te3%' THEN 'openai-te3'
 WHEN contains(lower(analyzers), 'embeddings') THEN 'miniLM' END"""

PAIRS = f"""prs AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, b.vec_id - a.vec_id AS gap, a.vec_id * {len(views.PAIR_GAPS)} + (b.vec_id - a.vec_id) AS pair_no,
   a.label = b.label AS is_similar, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
  FROM embeddings a JOIN (SELECT unnest({list(views.PAIR_GAPS)}) AS g) o ON true JOIN embeddings b ON b.vec_id = a.vec_id + o.g)"""

PAYLOADS = f"pl AS (SELECT doc_id, {views.PAYLOAD_SQL} AS payload FROM documents)"


def sentiment_ctes(source: str, lex: dict[str, float]) -> str:
    """Valence rules over ``source`` (a SELECT of doc_id, text)."""
    from textloom.operators import sentiment as st
    neg, con = in_list(lexicons.NEGATORS), in_list(lexicons.CONTRAST_WORDS)
    up = in_list(w for w, b in lexicons.BOOSTERS.items() if b > 0)
    down = in_list(w for w, b in lexicons.BOOSTERS.items() if b < 0)
    lags = ", ".join(f"coalesce(lag(boost, {i}) OVER o, 0.0) AS b{i}, coalesce(lag(neg, {i}) OVER o, false) AS n{i}" for i in (1, 2, 3))
    return values("val", "word, valence", sorted(lex.items())) + f""",
sx AS ({source}),
s0 AS (SELECT doc_id, regexp_matches(text, '\\p{{Ll}}') AND regexp_matches(text, '\\p{{Lu}}') AS mixed, regexp_extract_all(text, '{tx.WORD}') AS ws FROM sx),
s1 AS (SELECT doc_id, mixed, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM s0),
s2 AS (SELECT *, lower(word) AS lw, lower(word) IN {neg} AS neg,
   CASE WHEN lower(word) IN {up} THEN 0.293::DOUBLE WHEN lower(word) IN {down} THEN -0.293::DOUBLE ELSE 0.0::DOUBLE END AS boost,
   CASE WHEN lower(word) IN {con} THEN pos END AS contrast FROM s1),
s3 AS (SELECT *, min(contrast) OVER (PARTITION BY doc_id) AS fc, {lags} FROM s2 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
s4 AS (SELECT s3.*, CAST(val.valence AS DOUBLE) AS v0, CAST(sign(val.valence) AS DOUBLE) AS sg FROM s3 LEFT JOIN val ON val.word = lw),
s5 AS (SELECT *, v0 + CASE WHEN upper(word) = word AND length(word) > 1 AND mixed THEN sg * {st.CAPS_STEP}::DOUBLE ELSE 0.0::DOUBLE END
   + sg * (b1 * 1.0::DOUBLE + b2 * 0.95::DOUBLE + b3 * 0.9::DOUBLE) AS v1 FROM s4),
s6 AS (SELECT *, CASE WHEN n1 OR n2 OR n3 THEN v1 * (-0.74)::DOUBLE ELSE v1 END AS v2 FROM s5),
s7 AS (SELECT doc_id, CAST(round(1000000.0::DOUBLE * CASE WHEN fc IS NULL OR pos = fc THEN v2 WHEN pos < fc THEN v2 * 0.5::DOUBLE ELSE v2 * 1.5::DOUBLE END) AS BIGINT) AS m FROM s6),
s8 AS (SELECT doc_id, sum(coalesce(m, 0)) AS sm, sum(CASE WHEN m > 0 THEN m + 1000000 ELSE 0 END) AS ps,
   sum(CASE WHEN m < 0 THEN 1000000 - m ELSE 0 END) AS ng, count(*) FILTER (coalesce(m, 0) = 0) * 1000000 AS nu FROM s7 GROUP BY 1),
s9 AS (SELECT sx.doc_id, coalesce(sm, 0) AS sm, coalesce(ps, 0) AS ps, coalesce(ng, 0) AS ng, coalesce(nu, 0) AS nu,
   CAST(round(least(4, length(text) - length(replace(text, '!', ''))) * 0.292::DOUBLE * 1000000) AS BIGINT) AS bang FROM sx LEFT JOIN s8 ON s8.doc_id = sx.doc_id),
s10 AS (SELECT *, CAST(CASE WHEN sm > 0 THEN sm + bang WHEN sm < 0 THEN sm - bang ELSE sm END AS DOUBLE) / 1000000 AS x, CAST(ps + ng + nu AS DOUBLE) AS mass FROM s9),
senti AS (SELECT doc_id, round(coalesce(CAST(ng AS DOUBLE) / nullif(mass, 0), 0.0), 6) AS neg, round(coalesce(CAST(nu AS DOUBLE) / nullif(mass, 0), 0.0), 6) AS neu,
   round(coalesce(CAST(ps AS DOUBLE) / nullif(mass, 0), 0.0), 6) AS pos, round(x / sqrt(x * x + 15.0::DOUBLE), 6) AS compound FROM s10)"""
