"""Tables that a stream writes one folder at a time.

Every micro-batch writes its rows to ``<table>/epochs/epoch=<n>`` and nothing
else, so a batch that runs again after a crash replaces its own folder and no
other. Compaction writes a new folder as well and then a mark; readers take the
newest mark and the epochs after it. Nothing that was readable is rewritten, so
a run killed at any point loses nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "upto long"


def write_epoch(rows: DataFrame, table: str, epoch: int) -> None:
    """The rows of one micro-batch; the same batch run again replaces them."""
    rows.write.mode("overwrite").parquet(f"{table}/epochs/epoch={epoch}")


def _or_none(read, spark: SparkSession):
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def compacted_upto(spark: SparkSession, table: str) -> int:
    """The last epoch covered by the newest mark, -1 without one."""
    marks = _or_none(lambda: spark.read.schema(MARK).json(f"{table}/marks/*"), spark)
    return -1 if marks is None else max((r.upto for r in marks.collect()), default=-1)


def read_epochs(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """(columns of ``schema``, epoch long): what the newest compaction holds and
    the epochs after it. A table that was never written is empty."""
    upto = compacted_upto(spark, table)
    whole = f"{schema}, epoch long"
    out = None
    if upto >= 0:
        out = spark.read.schema(schema).parquet(f"{table}/compacted/upto={upto}").withColumn("epoch", F.lit(upto).cast("long"))
    later = _or_none(lambda: spark.read.schema(whole).parquet(f"{table}/epochs"), spark)
    if later is not None:
        later = later.where(F.col("epoch") > upto)
        out = later if out is None else out.unionByName(later)
    return spark.createDataFrame([], whole) if out is None else out


def newest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of the last epoch for each key."""
    return rows.groupBy(*keys).agg(F.max_by(value, "epoch").alias(value))


def compact(rows: DataFrame, table: str, upto: int, by: str) -> None:
    """Write ``rows``, what the epochs up to ``upto`` amount to, in folders by
    ``by``; the mark comes last and makes it count."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").partitionBy(by).parquet(f"{table}/compacted/upto={upto}")
    spark.createDataFrame([(upto,)], MARK).coalesce(1).write.mode("overwrite").json(f"{table}/marks/{upto:012d}")
