import math

import pytest
from pyspark.sql import functions as F

from rankweave.operators import content, recency

def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def test_hours_and_decay(spark):
    df = spark.createDataFrame([("2024-01-30 00:00:00",), ("2024-01-24 00:00:00",), (None,), ("2024-02-05 00:00:00",)],
                               "d string").select(F.col("d").cast("timestamp").alias("d"))
    h = [r["h"] for r in df.select(recency.hours_since(F.col("d"), now()).alias("h")).collect()]
    assert h == [24.0, 168.0, 8760.0, 0.0]
    assert math.exp(-0.01 * 24) == pytest.approx(0.7866, abs=1e-4)
    assert math.exp(-0.01 * 168) == pytest.approx(0.1864, abs=1e-4)


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, item long, bm25_score double, bm25_pos long, d string") \
        .withColumn("pub_date", F.col("d").cast("timestamp"))


def test_recency_reorders_and_lambda_zero_is_bm25(spark):
    rows = [(1, 0, 3.0, 1, "2023-01-01 00:00:00"), (1, 1, 2.0, 2, "2024-01-30 23:00:00"),
            (1, 2, 1.0, 3, "2024-01-30 23:00:00")]
    out = recency.recency_rerank(ranked(spark, rows), now(), top_k=2).orderBy("final_rank").collect()
    assert [r["item"] for r in out] == [1, 2]
    out0 = recency.recency_rerank(ranked(spark, rows), now(), top_k=3, decay_lambda=0.0).orderBy("final_rank").collect()
    assert [r["item"] for r in out0] == [0, 1, 2]


def test_negative_score_rises_with_age(spark):
    rows = [(1, 0, -1.0, 1, "2024-01-31 00:00:00"), (1, 1, -1.0, 2, "2024-01-30 00:00:00")]
    out = recency.recency_rerank(ranked(spark, rows), now(), top_k=2).orderBy("final_rank").collect()
    assert [r["item"] for r in out] == [1, 0]


def test_useful_content_first_n(spark):
    lengths = [50, 300, 200, 199, 500, 900]
    pages = spark.createDataFrame(
        [(i, f"http://p/{i}", f"<html><body><article><p>{'w' * n}</p></article></body></html>")
         for i, n in enumerate(lengths)], "page_id long, url string, html string")
    rows = spark.createDataFrame([(1, 0, i + 1, f"http://p/{i}") for i in range(len(lengths))],
                                 "query_id long, sec_pos long, rank long, url string")
    out = content.enrich_top_n(rows, pages, top_n=3).orderBy("rank").collect()
    assert [r["rank"] for r in out if r["content"] is not None] == [2, 3, 5]


def test_content_fallback(spark):
    df = spark.createDataFrame([("", "snip"), ("body", "snip"), (None, "snip")], "content string, snippet string")
    assert [r[0] for r in df.select(content.content_or(F.col("snippet"))).collect()] == ["snip", "body", "snip"]
