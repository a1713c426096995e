"""Pages and documents: extraction, counts, validity, routing, crawl planning, error rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.scale import bounded_broadcast, local_table, ordered_rank

MIN_CHARS = 10

# Error code, name and message.
ERRORS = {
    "GENERIC": (1, "GENERIC_ERROR", "the run failed"),
    "USAGE": (2, "USAGE_ERROR", "the request cannot be read"),
    "FETCH": (3, "FETCH_ERROR", "the page was not delivered"),
    "MODEL": (4, "MODEL_ERROR", "no language model could be used"),
}


def extract_pages(pages: DataFrame) -> DataFrame:
    """Page rows with text, title, domain and counts."""
    out = pages.select("page_id", "url", "html", tx.html_to_text(F.col("html")).alias("text"))
    return out.select(
        "page_id", "url", "html", "text", tx.page_title(F.col("html")).alias("title"),
        tx.url_domain(F.col("url")).alias("domain"), *content_counts(F.col("text")))


def content_counts(text: Column) -> list[Column]:
    return [F.length(text).cast("long").alias("char_count"), tx.word_count(text).alias("word_count")]


def violations(text: Column, title: Column | None = None, html: Column | None = None,
               confidence: Column | None = None) -> Column:
    """Names of the violated content constraints of a row, in a fixed order."""
    checks = []
    if title is not None:
        checks.append((F.coalesce(title, F.lit("")) == "", "title_empty"))
    checks.append((F.coalesce(text, F.lit("")) == "", "text_empty"))
    if html is not None:
        checks.append((F.coalesce(html, F.lit("")) == "", "html_empty"))
    checks.append((F.length(tx.strip(F.coalesce(text, F.lit("")))) < MIN_CHARS, "text_too_short"))
    if confidence is not None:
        checks.append((F.coalesce(~confidence.between(0.0, 1.0), F.lit(False)), "confidence_range"))
    return F.filter(F.array(*[F.when(test, name) for test, name in checks]), lambda x: x.isNotNull())


def with_validity(df: DataFrame, **columns: Column) -> DataFrame:
    out = df.withColumn("_bad", violations(**columns))
    return out.select("*", (F.size("_bad") == 0).alias("is_valid"),
                      F.array_join("_bad", ",").alias("reason")).drop("_bad")


def crawl_plan(pages: DataFrame, requests_per_second: float = 0.5) -> DataFrame:
    """Visit number of every page within its host and the earliest start that keeps the host's spacing."""
    interval = 1.0 / max(requests_per_second, 0.01)
    hosts = pages.select("page_id", tx.url_domain(F.col("url")).alias("host"))
    ranked = ordered_rank(hosts, by="host", order="page_id", rank="visit_no")
    return ranked.select("page_id", "host", "visit_no",
                         ((F.col("visit_no") - 1) * F.lit(interval)).alias("start_offset_s"))


def robots_filter(pages: DataFrame, rules: DataFrame, policy: str = "respect") -> DataFrame:
    """``allowed`` flag per page: the first rule of the host (by ``seq``) whose prefix matches decides.

    Hosts without rules, and every page under policy ``ignore``, are allowed. A page is looked up with those prefixes of its path that are as long as some rule of
    its host, so it meets at most one rule for each length, however many rules a host has, and rules and pages of a host are dealt by prefix.
    """
    rows = pages.select("page_id", "url", tx.url_domain(F.col("url")).alias("host"),
                        tx.url_path(F.col("url")).alias("path"))
    if policy == "ignore":
        return rows.select("page_id", "url", F.lit(True).alias("allowed"))
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))  # bounded by the longest prefix
    first = rules.groupBy("host", "prefix").agg(F.min(F.struct("seq", "allow")).alias("rule"))
    rows = rows.join(bounded_broadcast(lengths), "host", "left")
    rows = rows.select("page_id", "url", "host", "path", F.explode_outer(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    rows = rows.withColumn("prefix", F.substring("path", F.lit(1), F.col("n"))).join(bounded_broadcast(first), ["host", "prefix"], "left")
    return rows.groupBy("page_id", "url").agg(F.min("rule").alias("rule")).select("page_id", "url", F.coalesce("rule.allow", F.lit(True)).alias("allowed"))


def error_columns(kind: Column) -> list[Column]:
    """Code, name, message and JSON text for an error kind column (null kind means success)."""
    code, name, message = F.lit(0), F.lit("OK"), F.lit("")
    for key, (c, n, m) in ERRORS.items():
        code = F.when(kind == key, c).otherwise(code)
        name = F.when(kind == key, n).otherwise(name)
        message = F.when(kind == key, m).otherwise(message)
    body = F.to_json(F.struct(F.struct(code.alias("code"), name.alias("name"), message.alias("message")).alias("error")))
    return [code.alias("code"), name.alias("name"), message.alias("message"),
            F.when(kind.isNotNull(), body).alias("error_json")]


def batch_status(rows: DataFrame) -> DataFrame:
    """Number of rows per status, and whether the whole batch succeeded; a bad row never fails the job."""
    counts = rows.groupBy(F.when(F.col("is_valid"), "ok").otherwise("failed").alias("status")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts


def batch_succeeded(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_valid")).alias("failed"),
                    (F.count_if(~F.col("is_valid")) == 0).alias("success"))


def json_path_checks(rows: DataFrame, key: str, payload: str, bounds: dict[str, float | None]) -> DataFrame:
    """One row per (row, dotted path): is it present, and is it at least the bound when one is given."""
    checks = F.array(*[
        F.struct(F.lit(path).alias("path"),
                 F.get_json_object(F.col(payload), "$." + path).alias("value"),
                 F.lit(low).cast("double").alias("low"))
        for path, low in bounds.items()])
    out = rows.select(key, F.explode(checks).alias("c"))
    number = F.expr("try_cast(c.value AS DOUBLE)")
    return out.select(
        key, F.col("c.path").alias("path"), F.col("c.value").isNotNull().alias("present"),
        (F.col("c.value").isNotNull()
         & (F.col("c.low").isNull() | F.coalesce(number >= F.col("c.low"), F.lit(False)))).alias("ok"))


def rules_table(spark: SparkSession, rows: list[tuple[str, int, str, bool]]) -> DataFrame:
    return local_table(spark, rows, "host STRING, seq INT, prefix STRING, allow BOOLEAN")
