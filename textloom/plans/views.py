"""Input relations of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import extract, lexical, sentiment, tokens, trees
from textloom import lexicons
from textloom.scale import local_table, spread_small


# Valence for frequent invented words of the generated corpus. The registered queries pass it, so that the rules are exercised
# on that corpus.
INVENTED_VALENCE = {
    "thon": 1.9, "thatin": 1.4, "hehely": 2.6, "ther": -1.7, "thor": 0.9, "rewh": -0.8, "erth": -2.2, "thing": 1.1,
    "ononst": -1.5, "eque": 1.2, "que": 0.0, "éque": 1.3, "éeau": -1.6, "elle": 1.0, "tre": -0.7, "sch": 1.5,
    "ung": -1.1, "enau": 2.0, "lich": 0.8, "erte": -1.9, "ción": 1.6, "mente": -1.2, "ado": 0.7, "ciónue": -2.4,
}

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for jobs that shuffle by document themselves."""
    return table(spark, sf_dir, "documents")


def documents_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for map-only jobs: a large scan is used as it is, a small one is spread over the cores."""
    return spread_small(table(spark, sf_dir, "documents"), "doc_id")


def pages_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small(table(spark, sf_dir, "pages"), "page_id")


def tokens_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokens(documents(spark, sf_dir))


def tags_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens for counts with few groups a document: counted where they are, so that no text is shuffled."""
    return tokens.tokens(documents_rows(spark, sf_dir), clustered=False)


def arcs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.baseline_arcs(tokens_of(spark, sf_dir))


def sentences_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with baseline arcs, one row each."""
    return trees.document_sentences(documents_rows(spark, sf_dir))


def trees_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.with_tree(sentences_of(spark, sf_dir))


def annotated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token table as another annotator might give it: tokens hang on the next one, the last one is the root, adpositions hang on it and govern what follows;
    tags serve as labels."""
    order = Window.partitionBy("doc_id", "sent_id").orderBy("tok_id")  # one order for both, so that the tokens are sorted once
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = tokens_of(spark, sf_dir).withColumn("_last", F.max("tok_id").over(whole)).withColumn("_left", F.lag("upos").over(order))
    tok, last, left, upos = F.col("tok_id"), F.col("_last"), F.col("_left"), F.col("upos")
    dep = F.when(tok == last, "ROOT").when(upos == "ADP", "prep").when(left == "ADP", "pobj").otherwise(upos)
    head = F.when((tok == last) | (upos == "ADP"), last).when(left == "ADP", tok - 1).otherwise(tok + 1)
    return rows.withColumn("dep", dep).withColumn("head_id", head).drop("_last", "_left")


def valence(spark: SparkSession) -> DataFrame:
    return sentiment.valence_table(spark, {**lexicons.VALENCE, **INVENTED_VALENCE})


def polarity(spark: SparkSession) -> DataFrame:
    rows = [(w, p, s) for w, (p, s) in sorted(lexicons.polarity_of({**lexicons.VALENCE, **INVENTED_VALENCE}).items())]
    return local_table(spark, rows, "word STRING, polarity DOUBLE, subjectivity DOUBLE")


#: Turns as documents: one id per (conversation, turn). A turn number has 32 bits to itself, so ids of conversations never meet.
TURN_ID = "conv_id * 4294967296 + turn"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.expr(TURN_ID).alias("doc_id"), "conv_id", "turn", "role", "text")


# Run log: one row per event. The text is valid in both SQL dialects.
RUN_LOG_SQL = """
SELECT event_id AS pos, ts,
       CASE user_id % 10 WHEN 0 THEN 'en_wiki_bge_m3' WHEN 1 THEN 'en_wiki_openai_te3'
            ELSE concat('case_', CAST(user_id % 10 AS STRING)) END AS "case",
       CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'es' ELSE 'fr' END AS language,
       CASE event_type WHEN 'click' THEN 'embeddings' WHEN 'purchase' THEN 'sentiment'
            WHEN 'signup' THEN 'embeddings,sentiment' ELSE 'default' END AS analyzers,
       value AS seconds, event_type <> 'error' AS success
FROM events"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return spark.sql(RUN_LOG_SQL.replace('"case"', "`case`").replace("FROM events", "FROM {events}"), events=events)


RUN_SPLIT = "2024-01-16"

# Result payloads as JSON text, some of them broken on purpose. Valid in both SQL dialects.
PAYLOAD_SQL = """concat(
 '{"tool": "', CASE WHEN n_chars % 19 = 0 THEN 'other' ELSE 'textloom' END, '", "version": ',
 CASE WHEN n_chars % 41 = 0 THEN '1' ELSE '"0.1.0"' END,
 ', "source": {"type": "', CASE WHEN n_chars % 43 = 0 THEN 'ftp' ELSE 'file' END, '", "value": "', source, '", "domain": ""}',
 ', "language": {"code": "', lang, '", "confidence": ', CAST(CAST(floor(n_chars / 20000) AS BIGINT) AS STRING), '.',
 lpad(CAST(n_chars % 20000 * 5 AS STRING), 6, '0'),
 CASE WHEN n_chars % 37 = 0 THEN '' ELSE concat(', "model": "', lang, '_model"') END, '}',
 ', "content": {"title": ', CASE WHEN doc_id % 17 = 0 THEN 'null' ELSE concat('"doc ', CAST(doc_id AS STRING), '"') END,
 ', "char_count": ', CAST(n_chars AS STRING), ', "word_count": ', CASE WHEN n_chars % 23 = 0 THEN '-1' ELSE CAST(n_chars % 500 AS STRING) END, '}',
 ', "analyzers": [',
 CASE WHEN doc_id % 13 = 0 THEN '' ELSE '{"name": "lexical_stats", "processing_time": 0.25, "confidence": 1.0, "results": {"total_tokens": 5, "sentences": 2}}, ' END,
 '{"name": "', CASE WHEN n_chars % 29 = 0 THEN 'mystery' ELSE 'pos' END, '", "processing_time": 0.5, "confidence": 1.0, "results": {"upos_counts": {"NOUN": 3}}}, ',
 '{"name": "sentiment", "processing_time": 0.125, "confidence": 0.5, "results": ',
 CASE WHEN n_chars % 7 = 0 THEN '{"supported": false, "note": "none"}' ELSE '{"supported": true, "label": "neutral", "score": 0.0}' END, '}, ',
 '{"name": "keywords", ', CASE WHEN n_chars % 11 = 0 THEN '' ELSE '"processing_time": 0.75, ' END, '"confidence": ',
 CASE WHEN n_chars % 47 = 0 THEN '1.5' ELSE '1.0' END, ', "results": {"method": "frequency", "keywords": []',
 CASE WHEN n_chars % 53 = 0 THEN ', "label": "x"' ELSE '' END, '}}',
 ']', CASE WHEN n_chars % 31 = 0 THEN '' ELSE '}' END)"""


def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_rows(spark, sf_dir).select("doc_id", F.expr(PAYLOAD_SQL).alias("payload"))


#: Every vector is paired with its next four neighbours by id; equal labels make a similar pair.
PAIR_GAPS = (1, 2, 3, 4)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    left = ids.select(F.col("vec_id").alias("left_id"), F.col("label").alias("_l"),
                      F.explode(F.array(*[F.lit(g) for g in PAIR_GAPS])).alias("gap"))
    left = left.withColumn("right_id", F.col("left_id") + F.col("gap"))
    right = ids.select(F.col("vec_id").alias("right_id"), F.col("label").alias("_r"))
    return left.join(right, "right_id").select(
        "left_id", "right_id", "gap", (F.col("left_id") * len(PAIR_GAPS) + F.col("gap")).alias("pair_no"),
        (F.col("_l") == F.col("_r")).alias("is_similar"))


# Crawl rules for hosts that occur in the pages: host, order, path prefix, allowed.
ROBOTS_RULES = [
    ("spam-farm.example.org", 1, "/", False),
    ("www.cheap-pills.example.com", 1, "/en/4", True),
    ("www.cheap-pills.example.com", 2, "/en/", False),
    ("blog.tionsh.example.net", 1, "/es/5", True),
    ("blog.tionsh.example.net", 2, "/es/", False),
    ("blog.tionsh.example.net", 3, "/en/9", False),
    ("thther.example.org", 1, "/fr/", False),
    ("blog.ththan.example.net", 1, "/en/", True),
    ("blog.ththan.example.net", 2, "/", False),
]


def robots_rules(spark: SparkSession) -> DataFrame:
    return extract.rules_table(spark, ROBOTS_RULES)


# Two-word contractions of the corpus languages, split for the multi-word export.
CONTRACTIONS = {
    ("fr", "du"): ("de", "le"), ("fr", "des"): ("de", "les"), ("fr", "au"): ("à", "le"), ("fr", "aux"): ("à", "les"),
    ("de", "zum"): ("zu", "dem"), ("de", "zur"): ("zu", "der"), ("de", "im"): ("in", "dem"), ("de", "am"): ("an", "dem"),
    ("es", "del"): ("de", "el"), ("es", "al"): ("a", "el"),
}


def split_contractions(toks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Word rows and multi-word ranges of a token table whose contractions are split in two words."""
    table_ = F.create_map(*[F.lit(x) for k, v in CONTRACTIONS.items() for x in (":".join(k), "|".join(v))])
    parts = F.split(F.try_element_at(table_, F.concat_ws(":", "lang", "lower")), r"\|")
    order = Window.partitionBy("doc_id", "sent_id").orderBy("tok_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = toks.withColumn("_parts", parts)
    extra = F.coalesce(F.sum(F.when(F.col("_parts").isNotNull(), 1).otherwise(0)).over(order), F.lit(0))
    rows = rows.withColumn("_w", (F.col("sent_pos") + 1 + extra).cast("int"))
    forms = F.coalesce(F.col("_parts"), F.array("text"))
    words = rows.select("doc_id", "sent_id", "_w", "_parts", "lemma", "upos", "xpos", F.posexplode(forms).alias("_k", "form"))
    words = words.select(
        "doc_id", "sent_id", (F.col("_w") + F.col("_k")).alias("word_id"), "form",
        F.when(F.col("_parts").isNotNull(), F.col("form")).otherwise(F.col("lemma")).alias("lemma"), "upos", "xpos",
        F.lit("").alias("feats"), F.lit(None).cast("int").alias("head"), F.lit("").alias("deprel"), F.lit("").alias("misc"))
    ranges = rows.filter(F.col("_parts").isNotNull()).select(
        "doc_id", "sent_id", F.col("_w").alias("first_id"), (F.col("_w") + 1).alias("last_id"), F.col("text").alias("form"))
    return words, ranges


REQUIRED_ANALYZERS = ("lexical_stats", "pos", "sentiment", "keywords")
