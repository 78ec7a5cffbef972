"""Exclusion by a table of many keywords.

A short list is a chain of substring tests. A table of thousands is joined:
every keyword is looked for by one of its q-grams, the one that the fewest texts
hold, so only texts with that gram are tested for the keyword. Texts are taken
once each, whatever number of rows share them, and long texts meet their
candidates in one row, not once for each candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store

GRAM = 3
#: lists up to here are tested one keyword after the other
CHAIN = 64


def keyword_table(spark, keywords: list[str]) -> DataFrame:
    """(pos, keyword) of a list."""
    return spark.createDataFrame(list(enumerate(keywords)), "pos long, keyword string")


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters (of the empty text for size 0)."""
    if size == 0:
        return F.array(F.lit(""))
    # one pass of the regular expression engine; substrings by place would count from the start each time
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def first_keyword(df: DataFrame, text: Column, keywords: DataFrame, out_col: str = "keyword") -> DataFrame:
    """Add the first keyword by ``pos`` of (pos, keyword) that occurs in the
    text (case-sensitive substring; an empty keyword occurs in any), null
    without one. Null texts hold nothing, null keywords are passed over."""
    rows = df.withColumn("_text", text).withColumn("_hash", F.struct(F.xxhash64("_text"), F.xxhash64(F.lit(1), "_text")))
    texts = store(rows.where(F.col("_text").isNotNull()).groupBy("_hash").agg(F.first("_text").alias("_text")), "keyword-texts")
    words = store(keywords.where(F.col("keyword").isNotNull()).groupBy("keyword").agg(F.min("pos").alias("pos"))
                  .withColumn("_size", F.least(F.length("keyword"), F.lit(GRAM))), "keywords")
    sizes = [r["_size"] for r in words.select("_size").distinct().collect()]  # at most GRAM + 1
    if not sizes:
        return df.withColumn(out_col, F.lit(None).cast("string"))
    by_size = F.lit(None).cast("array<string>")
    for size in sizes:
        by_size = F.when(F.col("_size") == size, _grams(F.col("keyword"), size)).otherwise(by_size)
    keys = words.select("pos", "keyword", F.explode(by_size).alias("gram"))
    held = texts.select("_hash", F.explode(F.concat(*[_grams(F.col("_text"), s) for s in sizes])).alias("gram"))
    held = store(held.join(keys.select("gram").distinct(), "gram", "left_semi"), "keyword-grams")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a keyword with a gram that no text holds occurs nowhere
    rarest = (keys.join(counts, "gram", "left").groupBy("pos", "keyword")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
              .where("g.n > 0").select("pos", "keyword", F.col("g.gram").alias("gram")))
    tested = (held.join(rarest, "gram").groupBy("_hash")
              .agg(F.array_sort(F.collect_list(F.struct("pos", "keyword"))).alias("_candidates")))
    # the first that occurs, without testing those behind it
    start = F.lit(None).cast("string")
    found = F.aggregate("_candidates", start, lambda s, c: F.when(s.isNotNull(), s).when(
        F.contains("_text", c["keyword"]), c["keyword"]).otherwise(s))
    marked = texts.join(tested, "_hash").select("_hash", found.alias(out_col)).where(F.col(out_col).isNotNull())
    return rows.join(marked, "_hash", "left").drop("_hash", "_text")
