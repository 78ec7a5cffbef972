"""Call accounting and key rotation.

calls: (event_id, ts timestamp, key). Days are UTC calendar days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Fixed labels of the key assignment outcome.
QUOTA_EXCEEDED = "quota_exceeded"
UNAVAILABLE = "unavailable"
DAY_FORMAT = "yyyy-MM-dd"


def day_of(ts: Column) -> Column:
    return F.date_format(F.to_date(ts), DAY_FORMAT)


def calls_per_day(calls: DataFrame) -> DataFrame:
    """A1: (key, day, n). Every attempt counts."""
    return calls.groupBy("key", day_of(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def today_count(calls: DataFrame, keys: DataFrame, day: str) -> DataFrame:
    """A2: (key, n) for one day; 0 for a known key without calls that day.
    ``keys`` is the key registry (key)."""
    per_day = calls.filter(F.to_date("ts") == F.lit(day).cast("date")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"))
    return keys.select("key").distinct().join(per_day, "key", "left").select(
        "key", F.coalesce("n", F.lit(0)).alias("n"))


def daily_spine(calls: DataFrame) -> DataFrame:
    """A3: every known key on every day between the first and last call day,
    0 when it had no call (the reset view)."""
    bounds = calls.agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi"))
    days = F.sequence(bounds.select("lo").scalar(), bounds.select("hi").scalar())
    spine = calls.select("key").distinct().select("key", F.explode(days).alias("d"))
    spine = spine.select("key", F.date_format("d", DAY_FORMAT).alias("day"))
    return spine.join(calls_per_day(calls), ["key", "day"], "left").select(
        "key", "day", F.coalesce("n", F.lit(0)).alias("n"))


def day_sequence(calls: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per-day call number ``n`` (1-based, ordered by ts then event_id) with
    no task holding a whole day or a whole hot minute.

    Calls are range-partitioned on (ts, event_id) — Spark samples the keys, so
    a hot range is split like any other — and sorted inside each partition.
    Partition order is time order, so a row's number is its position inside
    its partition's run of that day plus the calls of that day in earlier
    partitions, taken from a small (partition, day) count table. The
    numbered rows are checkpointed so the split and the ids are fixed."""
    spark = calls.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (calls.withColumn("day", F.to_date("ts"))
               .repartitionByRange(n_parts, "ts", "event_id")
               .sortWithinPartitions("ts", "event_id")
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id()))
    ordered = cut_lineage(ordered)
    blocks = ordered.groupBy("_pid", "day").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("day").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_pid", "day", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    return (ordered.join(blocks, ["_pid", "day"])
            .withColumn("n", (F.col("_mid") - F.col("_first") + F.col("_off") + 1).cast("long"))
            .drop("_pid", "_mid", "_first", "_off"))


def quota_assign(calls: DataFrame, keys: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Walk keys in order and use the first whose count today is below
    ``daily_limit * threshold``. Counts only grow, so key i serves calls
    number cum_{i-1}+1 .. cum_i of the day, where cap_i = ceil(limit*threshold)
    (0 when the line is <= 0); later calls are ``quota_exceeded``; with no key
    at all every call is ``unavailable``.
    keys: (key_name, idx, daily_limit, threshold) — a small configuration table.
    before: (day, before) — calls of a day numbered already, one row a day.
    -> (event_id, ts, day, n, key_name)."""
    cap = F.greatest(F.ceil(F.col("daily_limit") * F.col("threshold")), F.lit(0)).cast("long")
    kw = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ks = keys.select("idx", "key_name", F.sum(cap).over(kw).alias("cum"))
    cfg = ks.agg(F.sort_array(F.collect_list(F.struct("idx", "cum", "key_name"))).alias("k"))
    arr = cfg.select("k").scalar()
    # the 1-row key table enters as a column first: lambdas may not hold subqueries
    seq = day_sequence(calls)
    if before is not None:
        earlier = before.select(F.to_date("day").alias("day"), F.col("before").alias("_before"))
        seq = (seq.join(earlier, "day", "left").withColumn("n", F.col("n") + F.coalesce("_before", F.lit(0))).drop("_before"))
    seq = seq.withColumn("_keys", arr)
    slot = F.filter(F.col("_keys"), lambda s: s["cum"] >= F.col("n"))
    assigned = (F.when(F.coalesce(F.size("_keys"), F.lit(0)) <= 0, F.lit(UNAVAILABLE))
                .when(F.size(slot) == 0, F.lit(QUOTA_EXCEEDED))
                .otherwise(slot[0]["key_name"]))
    return seq.select("event_id", "ts", F.date_format("day", DAY_FORMAT).alias("day"), "n",
                      assigned.alias("key_name"))


def usage_report(calls: DataFrame, keys: DataFrame, registry: DataFrame, day: str) -> DataFrame:
    """A4: for every source of a shared key group and every key: the endpoint,
    the day's count, limit, ratio (0 when the limit is 0) and remaining calls
    (sources sharing the keys repeat the same numbers); for every source
    without a key group one row with the count of its own calls (the key that
    the registry's ``call_key`` names) and no limit. Only the calls of the day
    are numbered."""
    today = calls.filter(F.to_date("ts") == F.lit(day).cast("date"))
    counts = quota_assign(today, keys).groupBy("key_name").agg(F.count(F.lit(1)).alias("count"))
    per_key = keys.join(counts, "key_name", "left").select(
        "key_name", "idx", "daily_limit", F.coalesce("count", F.lit(0)).alias("count"))
    srcs = registry.filter(F.col("shared_key_group").isNotNull()).select("engine", "endpoint", "pos")
    ks = per_key.agg(F.sort_array(F.collect_list(F.struct("idx", "key_name", "daily_limit", "count"))).alias("k"))
    rows = srcs.select("engine", "endpoint", "pos", F.explode(ks.select("k").scalar()).alias("s")).select(
        "engine", "endpoint", "pos", "s.*")
    ratio = F.when(F.col("daily_limit") == 0, F.lit(0.0)).otherwise(F.col("count") / F.col("daily_limit"))
    shared = rows.select("engine", "endpoint", "key_name", "count", "daily_limit", F.round(ratio, 6).alias("ratio"),
                         F.greatest(F.col("daily_limit") - F.col("count"), F.lit(0)).alias("remaining"))
    own = today.groupBy(F.col("key").alias("call_key")).agg(F.count(F.lit(1)).alias("n"))
    keyless = (registry.filter(F.col("shared_key_group").isNull()).join(own, "call_key", "left")
               .select("engine", "endpoint", F.lit(None).cast("string").alias("key_name"), F.coalesce("n", F.lit(0)).alias("count"),
                       F.lit(None).cast("long").alias("daily_limit"), F.lit(None).cast("double").alias("ratio"),
                       F.lit(None).cast("long").alias("remaining")))
    return shared.unionByName(keyless)


def write_counts(counts: DataFrame, path: str) -> None:
    """Persist per-day counts partitioned by day; rewriting a day replaces
    only that day's partition (dynamic overwrite of this write alone)."""
    (counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def read_counts(spark, path: str, skip_corrupt: bool = False) -> DataFrame:
    """Read counts back; a missing folder means no history. Any other
    failure is raised; ``skip_corrupt`` passes over damaged files."""
    from pyspark.errors import AnalysisException

    reader = spark.read.schema("key string, n long, day string").option("ignoreCorruptFiles", str(skip_corrupt).lower())
    try:
        return reader.parquet(path).select("key", "day", "n")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "key string, day string, n long")
