"""URL filter rules found through their rarest literal token.

A rule is a host and a path prefix. It is compiled to a regular expression and filed under one literal token: of all tokens that a
matching URL must contain, the one that the fewest URLs of the corpus have. Every distinct URL is cut into tokens, each token fetches the
rules filed under it, and only those rules run their regular expression. A URL that shares no filed token with a rule never meets it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.scale import local_table

#: Most bytes of rules (counted on their text and pattern) that are broadcast; a larger rule table is joined by a shuffle.
INDEX_BYTES = 8 << 20

TOKEN = "[a-z0-9\u0080-\U0010ffff]+"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Null or no ``://``: empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end. Null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_tokens(host: Column) -> Column:
    """Labels of the host, marked so that they never meet path tokens."""
    return F.transform(F.array_distinct(F.split(host, r"\.")), lambda t: F.concat(F.lit("h:"), t))


def path_tokens(path: Column) -> Column:
    """Segments of the path that end in a slash: whole pieces, so a rule ending inside a piece has no token there."""
    return F.transform(F.array_distinct(F.regexp_extract_all(path, F.lit(r"(?<=/)([^/]+)/"), F.lit(1))),
                       lambda t: F.concat(F.lit("p:"), t))


def escaped(s: str) -> str:
    """``s`` as a literal of a Java regular expression."""
    return re.sub(r"([^A-Za-z0-9_\-/\u0080-\U0010ffff])", r"\\\1", s)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules from (verdict, ``host/path``) pairs: rule, verdict, host, path, pattern, size of the rule.

    The pattern is read against host and path joined by a line feed, which no host contains.
    """
    rows = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        if not host:
            raise ValueError(f"rule without a host: {rule!r}")
        pattern = f"(?s)^(?:[^\\n]*\\.)?{escaped(host.lower())}\\n{escaped(slash + path)}"
        rows.append((rule, verdict, host.lower(), slash + path, pattern, len(rule)))
    return local_table(spark, rows, "rule STRING, verdict STRING, r_host STRING, r_path STRING, pattern STRING, length INT")


def small(rules: DataFrame) -> bool:
    """Whether the rules are proven to stay within ``INDEX_BYTES``: one aggregate over the rule table."""
    size = F.octet_length("rule") * 2 + F.octet_length("pattern") + 64
    return (rules.agg(F.sum(size)).first()[0] or 0) <= INDEX_BYTES


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, host, path, rule and verdict of every row.

    A rule fits its host and all subdomains when the path starts with the rule's path; the longest fitting rule wins, equal lengths are
    decided by the text of the rule. Where none fits, ``rule`` is null and ``verdict`` is ``default``.

    Null URLs and URLs without ``://`` have an empty host and path and fit no rule. Repeated rows come back each; an empty table of pages
    or rules is allowed; extra columns are not read.
    """
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("copies"))  # a common URL is judged once
    tokens = urls.select("host", "path", F.explode(F.concat(host_tokens(F.col("host")), path_tokens(F.col("path")))).alias("token"))
    bounded = small(rules)
    hint = F.broadcast if bounded else (lambda df: df)
    literal = rules.select("rule", "length", F.explode(F.concat(host_tokens(F.col("r_host")), path_tokens(F.col("r_path")))).alias("token"))
    wanted = literal.select("token").distinct()
    seen = tokens.join(hint(wanted), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = (literal.join(seen, "token", "left").groupBy("rule")
             .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest")))
    index = filed.select("rule", F.col("rarest.token").alias("token")).join(rules, "rule")
    # No more rows than rules, whose size was checked.
    candidates = tokens.join(hint(index), "token")
    fits = candidates.filter(F.expr("concat(host, '\n', path) RLIKE pattern"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("length", "rule", "verdict")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

JUDGE_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS h,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
), cut AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), judged AS (
  SELECT *, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM cut
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged"""
