"""Headline queries, timed end to end. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textloom.plans import catalog  # noqa: E402
from textloom.session import build_session  # noqa: E402

HEADLINE = [
    "html_to_text", "detect_language", "tokens", "lexical_stats", "top_lemmas", "pos_tags", "top_lemmas_by_upos", "ner_counts",
    "dep_counts", "readability", "text_standard", "keywords_frequency", "keywords_yake", "sentiment_valence", "embed_documents",
    "conllu_lines", "cosine_pairs", "topk_similar", "run_summary", "run_compare", "validate_payloads",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)) if cpus.isdigit() else "16", "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
