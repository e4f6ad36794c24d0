"""Structured Streaming over event logs: incremental ingest, windows with late data, deduplication, keyed state, joins.

The functions take and return streaming DataFrames; run() writes one to a file sink until its source is used up.
Append mode emits a window once the watermark has passed its end, so the last open windows wait for later events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wayfold.operators.knowledge import latest


def read_events(spark: SparkSession, path: str, late: str = "1 hour", files: int = 1000) -> DataFrame:
    """A stream of the Parquet files of a folder or pattern, `files` a batch; ts becomes a timestamp with a watermark."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def run(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """All that the stream has now, written to out/data with its progress in out/progress; a second call goes on
    where the first ended. Returns the table written so far."""
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/progress").format("parquet").start(f"{out}/data")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data")


def windows(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """start, end, event_type, n, total: tumbling windows, or sliding ones."""
    grouped = events.groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, start, end, n: runs of a user's events with pauses shorter than gap."""
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of(events: DataFrame, *keys: str) -> DataFrame:
    """One event a key among those within the watermark of each other; the state is dropped behind it."""
    return events.dropDuplicatesWithinWatermark(list(keys))


class _Totals(StatefulProcessor):
    """n and total of a user; the user's state ends when no event came for `idle` milliseconds of event time."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("totals", "n long, total double, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, total, last = self.state.get() if self.state.exists() else (0, 0.0, 0)
        for part in rows:
            n, total, last = n + len(part), total + float(part["value"].sum()), max(last, int(part["at"].max()))
        self.state.update((n, total, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "ended": [False]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, total, _ = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "ended": [True]})

    def close(self) -> None:
        pass


def running_totals(events: DataFrame, idle_seconds: int = 90 * 86_400) -> DataFrame:
    """user_id, n, total, ended: a user's totals after every batch in which the user has events, and once more with
    ended true when the watermark has passed the user's last event by idle_seconds; the user's state is dropped then, and
    a later event starts anew. So state is two numbers for each user of that time, not for each user ever. The session
    needs RocksDB for state (see state_store())."""
    own = events.select("user_id", "value", "ts", F.unix_millis("ts").alias("at"))
    return own.groupBy("user_id").transformWithStateInPandas(_Totals(1000 * idle_seconds), "user_id long, n long, total double, ended boolean", "Append", "EventTime")


def state_store(spark: SparkSession) -> None:
    """Keeps the state of streams that start from now on in RocksDB, which keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def upsert(stream: DataFrame, out: str, key: str, order: str) -> None:
    """All that the stream has now, as versions of rows by key: each batch writes the latest of its rows for each key (by
    order; ties: any one, so order should tell rows apart) to a folder of its own number. A batch that runs again after
    a failure writes the same folder again, so each event counts once over restarts. current() reads the table."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, [F.col(order).desc()]).write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    query = stream.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{out}/progress").start()
    query.awaitTermination()


def current(spark: SparkSession, out: str, key: str, order: str) -> DataFrame:
    """The latest row of each key over all batches of upsert(); of equal ones the later batch's."""
    rows = spark.read.parquet(f"{out}/data")
    return latest(rows, key, [F.col(order).desc(), F.col("batch").desc()]).drop("batch")


def followed(first: DataFrame, then: DataFrame, within: str) -> DataFrame:
    """user_id, first_id, then_id: pairs of a user's events of two streams, the second at most `within` later. The
    bound lets both sides' state be dropped behind the watermark."""
    a = first.select(F.col("user_id").alias("u"), F.col("event_id").alias("first_id"), F.col("ts").alias("t"))
    b = then.select("user_id", F.col("event_id").alias("then_id"), "ts")
    return a.join(b, F.expr(f"u = user_id AND ts >= t AND ts <= t + INTERVAL {within}")).select("user_id", "first_id", "then_id")
