"""Writers: payload JSON, flat Parquet summary, token JSON, CoNLL-U text and run-log CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_LOG_COLUMNS = ("timestamp", "case", "url", "language", "analyzers", "return_code", "seconds", "success")


def write_payloads(payloads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Payload text, one JSON object per line, in one folder per language (readers can skip languages)."""
    payloads.select("language", F.col("payload").alias("value")).write.mode(mode).partitionBy("language").text(path)


def write_summary(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Flat analyzer rows as Parquet, with the dotted column names of the exchange format."""
    dotted = [F.col(c).alias(c.replace("results_", "results.", 1) if c.startswith("results_")
                             else c.replace("metadata_", "metadata.", 1) if c.startswith("metadata_") else c)
              for c in summary.columns]
    summary.select(*dotted).write.mode(mode).parquet(path)


def write_token_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Token JSON, one document per line, with the document id added."""
    body = F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(","), F.substr("json", F.lit(2)))
    rows.select(body.alias("value")).write.mode(mode).text(path)


def write_conllu(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Text files in reading order. Documents are range-partitioned, so every file holds whole runs of sentences."""
    ordered = lines.repartitionByRange("doc_id", "sent_id").sortWithinPartitions("doc_id", "sent_id", "line_no")
    ordered.select(F.col("line").alias("value")).write.mode(mode).text(path)


def write_run_log_csv(log: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Run log with header and the eight fixed columns; other columns (errors) are dropped."""
    cols = [F.col(c) if c in log.columns else F.lit(None).cast("string").alias(c) for c in RUN_LOG_COLUMNS]
    log.select(*cols).write.mode(mode).option("header", True).csv(path)
