"""Analytics over run-log rows: case, analyzers, language, seconds, success, and a row position ``pos``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def infer_backend(case: Column, analyzers: Column) -> Column:
    """Embedding back end suggested by the case name, else by the analyzer list, else null."""
    name, listed = F.lower(F.coalesce(case, F.lit(""))), F.lower(F.coalesce(analyzers, F.lit("")))
    return (F.when(name.contains("bge_m3") | name.contains("bge-m3"), "bge-m3")
            .when(name.contains("openai_te3") | name.contains("openai-te3"), "openai-te3")
            .when(listed.contains("embeddings"), "miniLM"))


def _measures() -> list[Column]:
    seconds, ok = F.coalesce(F.col("seconds"), F.lit(0.0)), F.coalesce(F.col("success"), F.lit(False))
    n = F.count(F.lit(1))
    return [
        n.alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.round(F.coalesce(F.try_divide(F.count_if(ok), n), F.lit(0.0)), 6).alias("success_rate"),
        F.round(F.coalesce(F.avg(seconds), F.lit(0.0)), 6).alias("avg_time"),
        F.coalesce(F.min(seconds), F.lit(0.0)).alias("min_time"), F.coalesce(F.max(seconds), F.lit(0.0)).alias("max_time"),
        F.round(F.coalesce(F.sum(seconds), F.lit(0.0)), 4).alias("total_time"),
        F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_success")]


def run_summary(log: DataFrame) -> DataFrame:
    """One row of totals, rates and times over all rows (failed ones included in the times)."""
    return log.agg(*_measures())


def run_extremes(log: DataFrame) -> DataFrame:
    """Fastest and slowest case among the successes; the earlier row wins a tie. Null when nothing succeeded."""
    ok = log.filter("success")
    low = F.min(F.struct("seconds", "pos", F.col("case").alias("case_name")))
    high = F.max(F.struct(F.col("seconds"), (-F.col("pos")).alias("neg"), F.col("case").alias("case_name")))
    return ok.agg(low.alias("a"), high.alias("b")).select(
        F.col("a.case_name").alias("fastest_case"), F.col("a.seconds").alias("fastest_seconds"),
        F.col("b.case_name").alias("slowest_case"), F.col("b.seconds").alias("slowest_seconds"))


def run_by_backend(log: DataFrame) -> DataFrame:
    tagged = log.withColumn("backend", infer_backend(F.col("case"), F.col("analyzers")))
    return tagged.filter(F.col("backend").isNotNull()).groupBy("backend").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("seconds"), 6).alias("avg_time"),
        F.round(F.count_if("success") / F.count(F.lit(1)), 6).alias("success_rate"))


def run_filter(log: DataFrame, *, success_only: bool = False, failed_only: bool = False,
               min_time: float | None = None, max_time: float | None = None, language: str | None = None,
               analyzer: str | None = None, backend: str | None = None) -> DataFrame:
    """Rows that meet every given condition."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    tests = []
    if success_only:
        tests.append(ok)
    if failed_only:
        tests.append(~ok)
    if min_time is not None:
        tests.append(F.col("seconds") >= min_time)
    if max_time is not None:
        tests.append(F.col("seconds") <= max_time)
    if language:
        tests.append(F.col("language") == language)
    if analyzer:
        tests.append(F.col("analyzers").contains(analyzer))
    if backend:
        tests.append(F.lower(infer_backend(F.col("case"), F.col("analyzers"))) == backend.lower())
    for test in tests:
        log = log.filter(test)
    return log


def run_compare(log: DataFrame, is_second: Column) -> DataFrame:
    """Summary of two runs held in one log, and the improvement in percent (0 when the first value is not positive).

    Both runs are summarised in a single pass by conditional aggregates, so nothing is joined.
    """
    ok = F.coalesce(F.col("success"), F.lit(False))

    def side(test: Column, suffix: str) -> list[Column]:
        n = F.count_if(test)
        return [n.alias(f"total_{suffix}"), F.coalesce(F.avg(F.when(test, F.col("seconds"))), F.lit(0.0)).alias(f"avg_{suffix}"),
                F.coalesce(F.try_divide(F.count_if(test & ok), n), F.lit(0.0)).alias(f"rate_{suffix}")]

    rows = log.agg(*side(~is_second, "1"), *side(is_second, "2"))
    better = lambda a, gain: F.round(F.when(a > 0, gain / F.nullif(a, F.lit(0.0)) * 100.0).otherwise(0.0), 4)
    a1, a2, r1, r2 = (F.col(c) for c in ("avg_1", "avg_2", "rate_1", "rate_2"))
    return rows.select(
        "total_1", "total_2", F.round(a1, 6).alias("avg_time_1"), F.round(a2, 6).alias("avg_time_2"),
        F.round(r1, 6).alias("success_rate_1"), F.round(r2, 6).alias("success_rate_2"),
        better(a1, a1 - a2).alias("avg_time_improvement"), better(r1, r2 - r1).alias("success_rate_improvement"))


def run_summary_long(log: DataFrame) -> DataFrame:
    """The numeric summary as ``metric, value`` rows."""
    rows = run_summary(log).drop("all_success")
    values = [F.col(c).cast("double").alias(c) for c in rows.columns]
    return rows.select(*values).unpivot([], rows.columns, "metric", "value")


def sla_check(log: DataFrame, limit_seconds: float, by: str = "case") -> DataFrame:
    """Mean time per group and whether it breaks the limit."""
    return log.groupBy(by).agg(F.round(F.avg("seconds"), 6).alias("avg_time")).withColumn(
        "violation", F.col("avg_time") > limit_seconds)


def run_gate(log: DataFrame, limit_seconds: float) -> DataFrame:
    """Everything succeeded and the mean time is under the limit, with the report figures."""
    rows = run_summary(log)
    gate = F.col("all_success") & (F.col("avg_time") < limit_seconds)
    return rows.select("total", F.col("successful").alias("ok"), "failed", "avg_time", "max_time", "min_time",
                       gate.alias("gate_passed"))
