"""Structured Streaming call counters (ST1, ST2).

The call log is read as a stream; counts are kept in Spark's state store. The
caller names the table and the checkpoint folder, so a query started again on
the same paths resumes where it stopped: counters survive restarts and the
loss of executors. Update mode writes only the days that changed, and the
watermark lets Spark drop the state of days that can get no more calls.

The periodic report is driven by event-time timers: every key that was ever
called keeps a timer, so it reports each interval, also one without a call.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from . import epochs

WATERMARK = "1 day"
REPORT_EVERY = "60 seconds"
DAY_MS = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTS = "key string, start timestamp, n long, day string"
REPORT = "key string, start_ms long, n long, day_total long"
#: rows of a report handed to Spark at once
REPORT_ROWS = 10_000


def call_stream(spark: SparkSession, folder: str, file_glob: str, schema: str,
                key_col: str = "event_type", max_files: int = 1) -> DataFrame:
    """Streaming (event_id, ts timestamp, key) from parquet files in ``folder``."""
    raw = (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
           .option("maxFilesPerTrigger", max_files).parquet(folder))
    # event time must be a TIMESTAMP (not NTZ) for the watermark
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col(key_col).alias("key"))


def start(writer, trigger_once: bool = True, processing_time: str = REPORT_EVERY) -> StreamingQuery:
    """With ``trigger_once`` what is available is processed (``availableNow``)
    before the query returns; otherwise it triggers every ``processing_time``."""
    writer = writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime=processing_time)
    q = writer.start()
    if trigger_once:
        q.awaitTermination()
    return q


# -- ST1 ----------------------------------------------------------------------------

def window_counts(calls: DataFrame, interval: str, watermark: str = WATERMARK) -> DataFrame:
    """(key, start, at, n): calls by key and tumbling event-time window; ``at`` is the window's event time."""
    w = F.window("ts", interval)
    counted = calls.withWatermark("ts", watermark).groupBy(w.alias("w"), "key").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("key", F.col("w.start").alias("start"), F.window_time("w").alias("at"), "n")


def daily_counts(calls: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """ST1: per key per UTC day, updated as calls arrive."""
    return window_counts(calls, "1 day", watermark)


def counts_table(spark: SparkSession, table: str) -> DataFrame:
    """(key, start, n) of the table that :func:`run_to_table` keeps: the newest value of each counter."""
    return epochs.newest(epochs.read_epochs(spark, table, COUNTS), ["key", "start"], "n")


def run_to_table(counts: DataFrame, table: str, checkpoint: str, trigger_once: bool = True,
                 processing_time: str = REPORT_EVERY) -> StreamingQuery:
    """Run a streaming count in update mode; each micro-batch adds the counters
    it changed, with their totals so far, to ``table``."""
    def add(batch: DataFrame, epoch: int) -> None:
        day = F.date_format("start", "yyyy-MM-dd")
        epochs.write_epoch(batch.select("key", "start", "n", day.alias("day")), table, epoch)

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(add)
    return start(writer, trigger_once, processing_time)


def compact_counts(spark: SparkSession, table: str) -> None:
    """Put the newest value of every counter into one folder a day."""
    rows = epochs.read_epochs(spark, table, COUNTS)
    upto = rows.agg(F.max("epoch")).first()[0]
    if upto is not None and upto > epochs.compacted_upto(spark, table):
        merged = epochs.newest(rows.where(F.col("epoch") <= upto), ["key", "start", "day"], "n")
        epochs.compact(merged.repartition("day"), table, upto, "day")


def daily_report(table: DataFrame) -> DataFrame:
    """(key, day, n) from an ST1 table."""
    return table.select("key", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


# -- ST2 ----------------------------------------------------------------------------

class IntervalReport(StatefulProcessor):
    """Keeps, for one key, the counts of intervals not yet reported, the next
    interval to report and the total of the day. Finished intervals arrive
    already counted, so a key has one row for each interval with a call."""

    def __init__(self, interval_ms: int):
        self.interval = interval_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "next_ms long, day long, total long")
        self.pending = handle.getMapState("pending", "start_ms long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            for at, n in zip(part["start_ms"].tolist(), part["n"].tolist()):
                self.pending.updateValue((at,), (n,))
                first = at if first is None else min(first, at)
        if not self.known.exists():
            self.known.update((first, -1, 0))
            self.handle.registerTimer(first + self.interval)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All intervals that are over, then a timer for the next one."""
        until = timerValues.getCurrentWatermarkInMs()
        at, day, total = self.known.get()
        starts, counts, totals = [], [], []
        while at + self.interval <= until:
            n = 0
            if self.pending.containsKey((at,)):
                n = self.pending.getValue((at,))[0]
                self.pending.removeKey((at,))
            if at // DAY_MS != day:
                day, total = at // DAY_MS, 0
            total += n
            starts.append(at)
            counts.append(n)
            totals.append(total)
            at += self.interval
            if len(starts) == REPORT_ROWS:
                yield self._rows(key, starts, counts, totals)
                starts, counts, totals = [], [], []
        self.known.update((at, day, total))
        self.handle.registerTimer(at + self.interval)
        if starts:
            yield self._rows(key, starts, counts, totals)

    @staticmethod
    def _rows(key, starts, counts, totals) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key[0]] * len(starts), dtype=object), "start_ms": starts, "n": counts,
                             "day_total": totals})

    def close(self) -> None:
        pass


def _milliseconds(interval: str) -> int:
    amount, unit = interval.split()
    return int(amount) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]


def interval_reports(calls: DataFrame, interval: str = REPORT_EVERY, watermark: str = REPORT_EVERY) -> DataFrame:
    """ST2: streaming (key, start_ms, n, day_total), one row for every known key
    and finished interval from the key's first call on, with or without calls.
    An interval is finished when the watermark has passed its end; calls that
    come later still are dropped. Needs the RocksDB state store."""
    counted = window_counts(calls, interval, watermark)
    finished = counted.select("key", F.unix_millis("start").alias("start_ms"), "at", "n")
    return finished.groupBy("key").transformWithStateInPandas(IntervalReport(_milliseconds(interval)), REPORT, "Append", "EventTime")


class rocksdb_state:
    """The state store that timers need, for queries started inside."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, "spark.sql.streaming.stateStore.providerClass"

    def __enter__(self):
        self.before = self.spark.conf.get(self.name)
        self.spark.conf.set(self.name, ROCKSDB)

    def __exit__(self, *_):
        self.spark.conf.set(self.name, self.before)


def run_reports(reports: DataFrame, table: str, checkpoint: str, trigger_once: bool = True,
                processing_time: str = REPORT_EVERY) -> StreamingQuery:
    """Append the reports of :func:`interval_reports` to ``table``."""
    def add(batch: DataFrame, epoch: int) -> None:
        epochs.write_epoch(batch, table, epoch)

    writer = reports.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(add)
    with rocksdb_state(reports.sparkSession):
        return start(writer, trigger_once, processing_time)


def interval_report(spark: SparkSession, table: str) -> DataFrame:
    """(key, interval_start, n, day_total) from an ST2 table."""
    at = F.date_format(F.timestamp_millis("start_ms"), "yyyy-MM-dd HH:mm:ss")
    return epochs.read_epochs(spark, table, REPORT).select("key", at.alias("interval_start"), "n", "day_total")
