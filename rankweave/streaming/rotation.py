"""Key rotation on a live call log (W5 as a stream).

A call's number of the day depends on the calls before it, so a call waits in
state until the watermark has passed its minute. Two windowed aggregations hold
the calls: by instant, which drops a call later than the watermark, and by
minute. Both are dealt over HOLD_BUCKETS keys, so a busy minute does not sit in
one row of state. The calls that a micro-batch lets go are all later than those
of the batches before; they are numbered like a table (ranges sorted apart,
shifted by the counts before) and the day's count up to the last batch is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import quota
from ..session import store
from . import counters, epochs

HOLD_BUCKETS = 64
HOLD = "1 minute"
NUMBERED = "event_id long, ts timestamp, day string, n long, key_name string"


def final_calls(calls: DataFrame, watermark: str = counters.REPORT_EVERY, buckets: int = HOLD_BUCKETS) -> DataFrame:
    """Streaming (event_id, ts): calls whose minute the watermark has passed.
    A call without a time has no minute and is passed over."""
    dealt = calls.where("ts is not null").withWatermark("ts", watermark).select(
        F.pmod(F.xxhash64("event_id"), F.lit(buckets)).alias("bucket"), "event_id", "ts")
    # a list drops nulls, a struct of one is kept
    instants = dealt.groupBy("ts", "bucket").agg(F.collect_list(F.struct("event_id")).alias("calls"))
    at = F.unix_micros("ts").alias("us")
    minutes = instants.groupBy(F.window("ts", HOLD), "bucket").agg(F.collect_list(F.struct(at, "calls")).alias("instants"))
    return (minutes.select(F.explode("instants").alias("i")).select("i.us", F.explode("i.calls").alias("c"))
            .select("c.event_id", F.timestamp_micros("us").alias("ts")))


def run_rotation(calls: DataFrame, keys: DataFrame, table: str, checkpoint: str, watermark: str = counters.REPORT_EVERY,
                 trigger_once: bool = True, processing_time: str = counters.REPORT_EVERY) -> StreamingQuery:
    """Number and assign the calls of a stream (event_id, ts); see
    :func:`quota.quota_assign`. A call later than the watermark is dropped and
    counted by Spark as such. A batch run again replaces its own epoch: the
    counts it adds are those of earlier epochs only."""
    spark = calls.sparkSession

    def add(batch: DataFrame, epoch: int) -> None:
        # stored once: the state is read for every use of the batch
        held = store(batch.select("event_id", "ts"), "final-calls")
        before = (epochs.read_epochs(spark, table, NUMBERED).where(F.col("epoch") < epoch)
                  .groupBy("day").agg(F.max("n").alias("before")))
        epochs.write_epoch(quota.quota_assign(held, keys, before).select("event_id", "ts", "day", "n", "key_name"), table, epoch)

    writer = (final_calls(calls, watermark).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
              .foreachBatch(add))
    with counters.rocksdb_state(spark):
        return counters.start(writer, trigger_once, processing_time)


def rotation_table(spark: SparkSession, table: str) -> DataFrame:
    """(event_id, ts, day, n, key_name) of the calls assigned so far."""
    return epochs.read_epochs(spark, table, NUMBERED).drop("epoch")
