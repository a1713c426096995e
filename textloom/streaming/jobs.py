"""Structured Streaming versions of the row-wise analyses and of run monitoring.

Every job reads a growing folder, processes what is there (``availableNow``) and writes a parquet table. Table
and checkpoint live under the shared folder of the session, so a lost executor or a restart loses nothing.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textloom.functions import text as tx
from textloom.operators import extract, language, readability
from textloom.session import shared_dir

# The stateful processor travels with the job, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOCUMENT_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"


def drain(stream: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Run an append-mode stream over everything available and return the written table.

    Give ``out`` to continue an earlier run: the checkpoint next to it remembers what was processed.
    """
    spark = stream.sparkSession
    base = out or f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    run = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/_state")
           .trigger(availableNow=True).start(f"{base}/table"))
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def document_features(docs: DataFrame) -> DataFrame:
    """Row-wise analyses only (language, counts, readability): stateless, so they run unchanged on a stream."""
    tagged = language.detect_language(docs)
    scores = readability.scores(tagged, extra=("language", "language_confidence", "text"))
    return scores.select("doc_id", "language", "language_confidence", *extract.content_counts(F.col("text")),
                         "flesch_reading_ease", "flesch_kincaid_grade")


def stream_documents(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    docs = spark.readStream.schema(DOCUMENT_SCHEMA).parquet(path)
    return drain(document_features(docs), "documents", out)


def stream_run_monitor(spark: SparkSession, path: str, out: str | None = None, late: str = "1 hour",
                       width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Runs, mean seconds and success rate per (tumbling or sliding) window; later rows than ``late`` are dropped.

    Only windows that the watermark has closed are written.
    """
    events = spark.readStream.schema(EVENT_SCHEMA).parquet(path).withWatermark("ts", late)
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    stats = events.groupBy(span).agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("value"), 4).alias("avg_seconds"),
        F.round(F.count_if(F.col("event_type") != "error") / F.count(F.lit(1)), 6).alias("success_rate"))
    rows = stats.select(F.col("window.start").alias("window_start"), "runs", "avg_seconds", "success_rate")
    return drain(rows, "run-monitor", out)


def stream_dedup_urls(spark: SparkSession, path: str, out: str | None = None, horizon: str = "1 day") -> DataFrame:
    """Each URL once per horizon of arrival time; state older than the horizon is dropped."""
    pages = spark.readStream.schema(PAGE_SCHEMA).parquet(path)
    seen = pages.select("url", F.current_timestamp().alias("arrived")).withWatermark("arrived", horizon)
    return drain(seen.dropDuplicatesWithinWatermark(["url"]).select("url"), "urls", out)


def host_sessions(visits: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Visit sessions per host of a (streaming or static) table with ``url`` and ``ts``."""
    rows = visits.select(tx.url_domain(F.col("url")).alias("host"), "ts")
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("host", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("visits"))


def visits_of(events: DataFrame) -> DataFrame:
    """Requests of an event log: event_id, url and ts. Users stand for hosts."""
    return events.select("event_id", F.concat(F.lit("http://u"), F.col("user_id").cast("string"), F.lit(".example.org/"), F.col("event_type")).alias("url"), "ts")


def stream_host_sessions(spark: SparkSession, path: str, out: str | None = None, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of the requests of an event log, as soon as the watermark has closed them."""
    events = spark.readStream.schema(EVENT_SCHEMA).parquet(path)
    rows = host_sessions(visits_of(events), gap, late)
    return drain(rows.select("host", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "visits"), "host-sessions", out)


class Pacer(StatefulProcessor):
    """Start times of the requests to one host, ``spacing`` seconds apart at least. The host's state is the time at which it is free again; a timer drops it when
    the stream has been ``idle`` seconds past that time, after which a request would start at once anyway."""

    def __init__(self, spacing: float, idle: float):
        self.spacing, self.idle = spacing, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.free = handle.getValueState("free", "at DOUBLE, timer LONG")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        free, timer = self.free.get() if self.free.exists() else (float("-inf"), None)
        asked = pd.concat([r[["event_id", "at"]] for r in rows]).sort_values(["at", "event_id"], ignore_index=True)  # two numbers for each request
        starts = []
        for at in asked["at"]:
            starts.append(max(at, free))
            free = starts[-1] + self.spacing
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = int((free + self.idle) * 1000)
        self.handle.registerTimer(timer)
        self.free.update((free, timer))
        yield pd.DataFrame({"event_id": asked["event_id"], "host": key[0], "start": starts, "waited": [s - a for s, a in zip(starts, asked["at"])]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.free.clear()
        return iter(())

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_crawl_pacing(spark: SparkSession, path: str, out: str | None = None, spacing: float = 600.0, idle: float = 86_400.0, late: str = "1 hour") -> DataFrame:
    """Requests of an event log with the time at which each may start: event_id, host, start_ts, waited_s.

    Requests to a host start ``spacing`` seconds apart, in the order of their time inside a micro-batch. State lives in RocksDB, which timers need.
    """
    events = spark.readStream.schema(EVENT_SCHEMA).parquet(path).withWatermark("ts", late)
    rows = visits_of(events).select("event_id", tx.url_domain(F.col("url")).alias("host"), F.unix_micros("ts").cast("double") / 1e6, "ts").toDF("event_id", "host", "at", "ts")
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    paced = rows.groupBy("host").transformWithStateInPandas(
        statefulProcessor=Pacer(spacing, idle), outputStructType="event_id LONG, host STRING, start DOUBLE, waited DOUBLE", outputMode="Append", timeMode="EventTime")
    spark.conf.set(name, ROCKSDB)
    try:
        return drain(paced.select("event_id", "host", F.timestamp_micros(F.round(F.col("start") * 1e6).cast("long")).alias("start_ts"), F.round("waited", 3).alias("waited_s")),
                     "crawl-pacing", out)
    finally:
        spark.conf.set(name, before)
